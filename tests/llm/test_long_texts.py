"""One text of many megabytes, a null, and an empty one through every operator on documents."""

import hashlib

import pytest

from parley.llm import queries

WORDS = "time flies like an arrow and fruit flies like a banana while the rain in spain stays mainly in the plain".split()


@pytest.fixture(scope="module")
def long_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    long = "\n".join(" ".join([*WORDS[k % 7 : k % 7 + 12], f"n{k}"]) for k in range(80_000))  # over 5 MB, every line another
    rows = [(1, long, "en", "a"), (2, "short text here", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (20, long + " x", "en", "a"), (21, "ein kurzer text", "de", "b"), (22, "noch ein text", "de", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, long


@pytest.mark.parametrize("name", ["op1_simhash", "op2_shards", "op4_media", "op6_langid", "op7_mixing", "op8_katz", "op10_bpe", "op11_periodic"])
def test_long_text(spark, long_folder, name):
    path, long = long_folder
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, path).collect()}
    assert set(rows) == {1, 2, 3, 4, 20, 21, 22}
    words = long.split()
    if name == "op1_simhash":
        assert rows[1].component_id == rows[20].component_id == 1 and rows[3].fingerprint == "0" * 16
    elif name == "op2_shards":
        assert rows[1].size == len(long) + 8
    elif name == "op4_media":
        assert rows[1].n_bytes == len(long) and rows[3].n_bytes == 0
    elif name in ("op7_mixing", "op8_katz"):
        assert rows[1].n_tokens == len(words) + (name == "op8_katz")
    elif name == "op10_bpe":
        assert rows[1].decoded_sha256 and rows[1].n_tokens > len(words)
    elif name == "op11_periodic":
        assert rows[1].n_runs == 0 and rows[1].collapsed_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_long_lines(spark, long_folder):
    """All lines of the second long text repeat the first's, but for its last."""
    path, long = long_folder
    rows = {r.doc_id: r for r in queries.QUERIES["op9_lines"](spark, path).collect()}
    n = long.count("\n") + 1
    assert rows[20].n_lines == n and rows[20].n_removed >= n - 1 and rows[1].n_lines == n
