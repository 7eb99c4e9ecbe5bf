"""Faces and files are joined by shuffles: neither is small."""

from gridloom.operators import fonts


def test_neither_faces_nor_files_are_broadcast(spark):
    faces = spark.createDataFrame([("r", "a/s.css", 1, "X", "f.woff2"), ("r", "a/s.css", 2, "Y", "g.woff2")], "repo_id string, path string, line int, family string, url string")
    assets = spark.createDataFrame([("r", "a/f.woff2", bytearray(b"wOF2x")), ("r", "public/f.woff2", bytearray(b"wOF2y"))], "repo_id string, path string, content binary")
    rows = fonts.font_evidence(faces, assets)
    assert {(r["line"], r["asset"], r["state"]) for r in rows.collect()} == {(1, "a/f.woff2", "verified"), (2, None, "not-visible")}
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
