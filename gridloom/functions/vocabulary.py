"""Fixed values of the audit: enumerations, word lists, thresholds and weights, in their order."""

CHECKS = ["tier-integrity", "leakage", "coverage", "mode-completeness", "naming-coherence", "single-source", "orphans", "enforcement"]
GRADES = ["healthy", "watch", "needs-work", "not-visible", "not-needed"]
SEVERITY = ["needs-work", "not-visible", "watch", "healthy", "not-needed"]
TIERS = ["primitive", "semantic", "component", "untraced"]
LEAK_TIERS = ["redundant", "exact-value candidate", "near-miss", "uncovered"]
STAGES = ["scattered", "declared", "adopted", "layered", "complete", "held"]
CAPABILITIES = ["detection", "production_roots", "import_resolution", "token_source_discovery", "ownership", "mode_resolution", "runtime_verification"]
FAMILIES = [
    "color", "typography", "spacing", "sizing", "radius", "border", "elevation", "opacity", "layer", "motion", "breakpoint",
    "grid", "focus", "target", "state", "icon", "aspect", "blur", "density",
]
#: Names that tell a family, as whole hyphen segments.
FAMILY_NAMES = {
    "typography": ["font", "typography", "typeset", "text-size", "line-height", "letter-spacing", "text-case", "text-decoration", "paragraph-spacing"],
    "spacing": ["space", "spacing", "gap", "padding", "margin", "inset"],
    "sizing": ["size", "width", "height", "measure", "dimension"],
    "radius": ["radius", "rounded", "corner"],
    "border": ["border", "stroke", "outline", "divider"],
    "elevation": ["shadow", "elevation", "depth", "box-shadow"],
    "opacity": ["opacity", "alpha", "transparency"],
    "layer": ["z-index", "zindex", "layer", "layers", "stacking", "elevation-z"],
    "motion": ["motion", "duration", "easing", "delay", "transition", "animation", "spring"],
    "breakpoint": ["breakpoint", "screen", "viewport", "media"],
    "grid": ["grid", "column", "columns", "gutter", "container", "layout", "wrapper"],
    "focus": ["focus", "focus-ring", "outline-focus"],
    "target": ["target", "touch", "hit-area", "min-target"],
    "state": ["state", "state-layer", "interaction", "overlay"],
    "icon": ["icon", "iconography", "glyph"],
    "aspect": ["aspect", "ratio", "aspect-ratio"],
    "blur": ["blur", "backdrop", "frost"],
    "density": ["density", "compact", "comfortable"],
}
#: The order in which structural families are asked first.
STRUCTURAL = ["focus", "target", "aspect", "blur", "density", "state", "layer", "motion", "breakpoint", "grid", "radius", "border", "elevation"]
COLOR_NAMES = ["color", "colour", "palette", "fill", "bg", "background", "surface", "content", "primary", "secondary", "neutral"]
#: Segments by which a token's own name states its layer.
TIER_MARKERS = [("primitive", ["primitive", "primitives", "ref", "palette", "raw"]), ("semantic", ["semantic", "alias"]), ("component", ["component"])]
GENERIC_FONTS = ["serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "ui-serif", "ui-sans-serif", "ui-monospace", "inherit", "initial", "unset"]
TOKEN_DIRECTORIES = ["token", "tokens", "design-token", "design-tokens", "designtokens", "theme", "themes", "foundation", "foundations", "primitive", "primitives"]
FIX_WEIGHTS = {"compiled-runtime verified": 1.0, "exact static match": 0.95, "import-graph verified": 0.9, "manual review": 0.4}
ROOT_RANK = ["not-visible", "static candidate", "import-graph verified", "framework-registered", "runtime verified"]
COMPONENT_RANK = ["path-inferred", "co-named-source", "framework-registered", "import-graph verified", "runtime verified"]
#: (band, cumulative share in percent below which a row begins it)
ROADMAP_BANDS = [("assess-first", 50), ("plan-next", 80), ("focused-follow-up", 100)]
CONSEQUENCE = ["color", "motion", "elevation", "z-index", "typography", "breakpoint", "dimension"]
UTILITY_NAMESPACES = [
    "color", "text", "font-weight", "font", "leading", "tracking", "radius", "inset-shadow", "drop-shadow", "shadow", "blur",
    "perspective", "ease", "animate", "container", "max-width", "aspect", "spacing", "breakpoint", "default",
]
UNRESOLVED_REASONS = ["entry point does not exist", "framework built-in", "remote dependency", "external package", "dynamic runtime import", "ambiguous profile rewrite", "unsupported resolver", "missing local source"]
ACTIONABLE_REASONS = ["missing local source", "unsupported resolver", "dynamic runtime import", "ambiguous profile rewrite"]
TEXT_CONTRAST, GRAPHIC_CONTRAST = 4.5, 3.0
