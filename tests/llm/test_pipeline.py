"""The pipeline's stages, each against a plain version on what the stage before kept."""

from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import cases


def test_stages(spark, tmp_path):
    rows = [r for r in cases.rows()]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows], columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(enumerate(cases.texts()))
    items = {3: texts[15][100:260], 4: "something else entirely that is in no document of this small table"}
    spark.createDataFrame([*items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.collect()}
    assert not kept["language"] & {0, 1, 2, 6}
    last = {texts[d]: d for d in sorted(kept["language"])}
    assert kept["exact"] == set(last.values())
    groups = cases.components({d: texts[d] for d in kept["exact"]}, 5, 80, 100)
    assert kept["near"] == {c for _, c in groups.values()}
    assert kept["benchmark"] == {d for d, x in cases.hits({d: texts[d] for d in kept["near"]}, items).items() if not x[1]}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept["benchmark"]
    library, by_doc, by_sequence = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, own in by_doc.items():
        ids, at = [*library.encode(texts[d], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), cases.crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    assert len(by_sequence) <= sum(r.length for r in packed) / 2048 + 2


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns named like the operators' results: a row each of what is left, columns as given."""
    good = "en to tre fire fem seks syv otte ni ti elleve tolv " * 3
    rows = [(1, good, "aa", "s", 1, "x"), (1, good, "aa", "s", 1, "x"), (None, good, "aa", "s", 1, "y"), (None, None, None, None, None, None), (2, "", "aa", "s", 0, "x"), (None, "alone " + good, "aa", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string").withColumns({"score": F.lit(1), "row": F.lit("r"), "kept": F.lit(None).cast("string")})
    spark.createDataFrame([(None, None), (1, "nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(now.count())
    assert counts == [4, 2, 1, 1] and now.first().doc_id == 1 and now.first().score == 1
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).agg(F.sum("length")).first()[0] > 36


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
