import re
from pathlib import Path

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as near
from weft.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"


def test_against_plain_python(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if any(c.isalpha() for c in r[1])]
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    rows = [r for r in rows if r[0] in first.values()]
    label = near([t for _, t in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    found = {d for d, _ in leaks(rows, items)}
    rows = [r for r in rows if r[0] not in found]
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: encoding.encode_ordinary(t) for i, t in rows} and found


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_tables(spark, odd, empty, tmp_path, kind):
    docs = {"odd": odd, "empty": empty}[kind]
    spark.createDataFrame([(1, "never found in any of these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.count() <= docs.count() and (name == "byte_bpe" or after.columns == docs.columns)
        docs = after


def test_registered():
    names = __spark_entry__.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] and "pipeline" in names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    for path in (Path(corpus_pipeline.__file__), *Path("weft/llm").glob("*.py")):
        assert "ImportError" not in path.read_text()
