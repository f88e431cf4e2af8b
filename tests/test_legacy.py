import json

from quernel.operators import vectors
from quernel.sources.legacy import json_manifest, json_vectors


def test_json_index_files(spark, tmp_path):
    meta = {"path": "a.md", "title": "A", "tags": "x,y", "heading": "", "start_line": 1, "end_line": 2, "text": "t"}
    (tmp_path / "vectors.json").write_text(json.dumps({"entries": [{"vector": [1.0, 0.0], "metadata": meta}, {"vector": [0.0, 1.0], "metadata": meta | {"path": "b.md"}}]}, indent=1))
    (tmp_path / "hashes.json").write_text(json.dumps({"a.md": "00", "b.md": "01"}))
    (tmp_path / "broken.json").write_text("{")
    held = json_vectors(spark, str(tmp_path / "vectors.json"))
    assert [r.path for r in vectors.knn(held, [1, 0], 1).collect()] == ["a.md"]
    assert {tuple(r) for r in json_manifest(spark, str(tmp_path / "hashes.json")).collect()} == {("a.md", "00"), ("b.md", "01")}
    assert json_manifest(spark, str(tmp_path / "broken.json")).count() == 0
