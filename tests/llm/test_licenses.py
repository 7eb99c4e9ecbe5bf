from gridloom.llm import licenses as li


def test_whole_texts_only(spark, docs, no_docs):
    mit = next(t for i, t in li.KNOWN if i == "MIT")
    rows = [
        (1, mit, "MIT"), (2, "MIT Licence\n\nCopyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + mit.upper().replace(". ", ".\n\n  * ").replace("SUBLICENSE", "sub-licence"), "MIT"), (3, "intro text\n" + mit, None),
        (4, "Licensed under the Apache Licence, v2.0", "Apache-2.0"), (5, None, None), (6, "", None), (7, "Copyright 2020 X", None), (8, "// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), (8, "© 2021 Y\n# SPDX-License-Identifier: BSD-2-Clause\n", "BSD-2-Clause"), (None, "released under the mit license", "MIT"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, license string")
    got = sorted(((r["doc_id"], r["license"]) for r in li.scan_licenses(df).collect()), key=str)
    assert got == sorted(((i, x) for i, _, x in rows), key=str)
    assert li.scan_licenses(no_docs).collect() == []
    assert li.scan_licenses(docs).count() == docs.count()


def test_canonical_forms_do_not_collide_across_licenses(spark):
    by = {}
    for r in spark.createDataFrame(li.KNOWN, "license string, text string").select("license", li.canonical(li.F.col("text")).alias("c")).collect():
        assert by.setdefault(r["c"], r["license"]) == r["license"]
