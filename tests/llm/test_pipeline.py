"""The pipeline's stages, each against brute force on its own input."""
import collections
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import bpe, secrets

from .test_text_operators import WORD, components, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    parts = {"en": ["the", "ing", "tion", "wh", "ed"], "fr": ["eau", "é", "ou", "que", "ment"]}
    rows = []
    for i in range(80):
        lang = draw.choice(["en", "fr"])
        text = " ".join("".join(draw.choices(parts[lang], k=3)) for _ in range(draw.choice((8, 60, 120))))
        if i % 6 == 0 and rows:
            text = rows[-1][1] + draw.choice(("", " more", " password=abcdef123"))
            lang = rows[-1][2]
        if i % 9 == 0:
            text += "\n token: " + "".join(draw.choices("abcdef0123456789", k=30))
        rows.append((i, text, lang, draw.choice(["a", "b", None]), len(text)))
    rows += [(90, None, "en", "a", 0), (91, "", "en", "a", 0), (92, "123 -- 456", "fr", "b", 10)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        before_rows, rows = docs.collect(), after.collect()
        if name != "bpe":
            assert after.columns == COLUMNS
        check = globals()[f"check_{name}"]
        check(before_rows, rows)
        docs = after
    whole = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert whole == sorted((r.doc_id, r.ids_sha256) for r in rows)


def test_stages_of_an_empty_table_and_of_hard_rows(spark, folder, tmp_path):
    """An empty table, then repeated rows, a null doc_id and a null source, through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    some = spark.read.parquet(f"{folder}/documents.parquet").collect()
    hard = [tuple(r) for r in some[:30]] + [tuple(some[1])] * 3 + [(None, some[2].text, "en", None, 1), (None, None, None, None, None)]
    for name, rows in (("empty", []), ("hard", hard)):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/documents.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert bool(out) == bool(rows)
    assert {r.doc_id for r in out} <= {r[0] for r in hard}


def check_language_id(before, after):
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {90, 91, 92}


def check_near_dedup(before, after):
    rows = sorted(before, key=lambda r: r.doc_id)
    sets = [shingle_set(r.text) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = components(len(rows), links)
    assert sorted(r.doc_id for r in after) == [r.doc_id for i, r in enumerate(rows) if label[i] == i]
    assert len(after) < len(before)


def check_secrets(before, after):
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == secrets.redacted(texts[r.doc_id]) and r.n_chars == len(r.text) for r in after)
    assert len(before) == len(after) and not any(secrets.all_spans(r.text) for r in after)
    assert any(r.text != texts[r.doc_id] for r in after)


def check_mixing(before, after):
    texts = {r.doc_id: r.text for r in before}
    sizes, taken, source = collections.Counter(), collections.Counter(), {r.doc_id: r.source for r in before}
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in after:
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
        taken[source[r.doc_id]] += len(WORD.findall(r.text))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.35)
    assert all(taken[s] <= 2 * sizes[s] for s in sizes)


def check_bpe(before, after):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((r.doc_id, library.encode_ordinary(r.text)) for r in before)
    assert sorted((r.doc_id, list(r.ids)) for r in after) == expected
    assert sorted(r.decoded_sha256 for r in after) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before)

CLASHING = ("h", "buckets", "within", "bucket_start", "source_size", "p", "a.b", "key", "bucket", "turn", "size", "piece", "block", "start", "kept", "component_id", "score", "lang_pred", "carried_0_", "a b", "`q`")


def test_stages_carry_columns_of_any_name(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{i}:"), "doc_id").alias(c) for i, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in stage(spark, wide, folder).select([F.col("`" + c.replace("`", "``") + "`") for c in wide.columns]).collect()]
        plain = [tuple(r) for r in stage(spark, docs, folder).collect()]
        assert sorted(map(str, (r[:5] for r in rows))) == sorted(map(str, plain)) and rows
        assert all(r[5 + i] == f"{i}:{r[0]}" for r in rows for i in range(len(CLASHING))), name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, wide, folder).count() == docs.count()


def test_a_run_leaves_the_last_rows_only_and_nothing_when_it_fails(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, folder).count()
    (left,) = tmp_path.iterdir()
    assert [p.name for p in left.iterdir()] == [corpus_pipeline.STAGES[-1][0]]

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:2], ("broken", broken)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, folder)
    assert list(tmp_path.iterdir()) == [left]
