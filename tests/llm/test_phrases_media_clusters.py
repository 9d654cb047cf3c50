"""Phrase collocations, media columns and centroid clustering against brute force."""
import hashlib
import io
import math
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm import centroids, collocations, media

DOCS = "doc_id long, text string, lang string, part string, n long, rank long, media string"


def documents(spark, rows):
    return spark.createDataFrame([(i, text, lang, "p", 1, 2, "m") for i, text, lang in rows], DOCS)


# ------------------------------------------------------------------ phrases


def brute_phrases(rows, most=5, least=3, percent=100, top=2000):
    counts, words = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            held = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(held)
            for i in range(len(held)):
                for k in range(1, min(most, len(held) - i) + 1):
                    counts[lang, tuple(held[i : i + k])] += 1
    out = set()
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for lang in words:
        found = []
        for (of, phrase), a in candidates.items():
            if of != lang:
                continue
            longer = [b for (x, p), b in candidates.items() if x == lang and len(p) > len(phrase) and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
            if any(100 * b >= percent * a for b in longer):
                continue
            cuts = []
            for k in range(1, len(phrase)):
                left, right = counts[lang, phrase[:k]], counts[lang, phrase[k:]]
                cuts.append((1000 * a * words[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, words[lang], -score))
    return out


def phrase_rows(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["the", "Of", "new", "york", "city", "a", "a\x01", "a\x00b", "größe", "b!c", "x:", "\x01", "A", "日本"]
    rows = []
    for i in range(n):
        words = [draw.choice(vocabulary[: draw.choice([3, 14])]) for _ in range(draw.randrange(1, 60))]
        gaps = [draw.choice([" ", " ", "\t ", "\n", ", ", " ... "]) for _ in words]
        rows.append((i, "".join(w + g for w, g in zip(words, gaps)), draw.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "the new york city", "en"), (900, None, "en"), (901, "", "de"), (902, " ,,\n", "fr"), (903, "q " * 9, "fr")]
    return rows + [rows[0]] * 4


@pytest.mark.parametrize("filter_bits", [8, 1 << 20])
def test_phrases_match_brute_force(spark, filter_bits):
    rows = phrase_rows(1)
    got = [tuple(r) for r in collocations.collocations(documents(spark, rows), least=3, filter_bits=filter_bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows)
    assert len(got) > 100


def test_phrases_top_percent_and_lengths(spark):
    rows = phrase_rows(2, 60)
    got = {tuple(r) for r in collocations.collocations(documents(spark, rows), most=3, least=2, percent=60, top=7).collect()}
    assert got == brute_phrases(rows, 3, 2, 60, 7)


def test_phrases_of_one_text_that_repeats(spark):
    rows = [(i, "buy now cheap " * 50, "en") for i in range(40)] + [(i, f"buy now x{i} y{i}", "en") for i in range(200)]
    got = {tuple(r) for r in collocations.collocations(documents(spark, rows), least=100).collect()}
    assert got == brute_phrases(rows, least=100)


def test_phrases_of_nothing(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "", "en")])).count() == 0
    assert collocations.collocations(documents(spark, [(1, "all words are rare here", "en")])).count() == 0


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 50)
    draw = random.Random(3)
    text = "".join(draw.choice(["ab ", "c", ", ", "dd dd dd dd "]) for _ in range(400)).encode() + b"w" * 300 + b"\nend"
    parts = list(collocations._parts(text))
    assert b"".join(parts) == text and len(parts) > 20
    assert all(re.search(rb"[.,;:!?\x0a-\x0d]$", part) for part in parts[:-1])


def test_the_stack_goes_from_batch_to_batch():
    draw = random.Random(4)
    held = Counter()
    for _ in range(500):
        held[draw.choice(["de", "en"]), tuple(draw.choice("ab" if draw.random() < 0.9 else "abc") for _ in range(draw.randrange(1, 6)))] += draw.randrange(1, 5)
    expected = Counter()
    for (lang, words), n in held.items():
        for k in range(1, len(words) + 1):
            expected[lang, " ".join(words[:k])] += n
    rows = sorted(((lang, "\0".join(words).encode(), n) for (lang, words), n in held.items()), reverse=True)
    for size in (1, 2, 7, len(rows)):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), (pa.string(), pa.binary(), pa.int64()))], ["lang", "suffix", "n"])
            for i in range(0, len(rows), size)
        ]
        for least in (1, 40):
            edges = {(rows[j][0], " ".join(rows[j][1].decode().split("\0")[: k + 1])) for j in (0, -1) for k in range(rows[j][1].count(b"\0") + 1)}
            found = [tuple(r.values()) for b in collocations._stacked(5, least)(iter(batches)) for r in b.to_pylist()]
            assert len(found) == len({f[:2] for f in found})
            assert {f[:2]: f[2] for f in found} == {key: n for key, n in expected.items() if n >= least or key in edges}


def test_shared_words_of_long_suffixes():
    words = [b"x" * 400 + b"\0" + b"y" * 300, b"x" * 400 + b"\0" + b"y" * 299, b"x" * 400, b"x" * 399 + b"\0z", b"q"]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0] + [len(w) for w in words])
    sizes, shared = collocations.shared_words(data, offsets, np.array([False, True, True, True, True]))
    assert sizes.tolist() == [2, 2, 1, 2, 1] and shared.tolist() == [0, 1, 1, 0, 0]


# ------------------------------------------------------------------ media


def brute_landmarks(payload):
    """Peaks and pairs of one payload with whole numbers only."""
    table = media._table().astype(np.int64)
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    power = []
    for at in range(0, len(samples) - media.FRAME + 1, media.HOP):
        both = samples[at : at + media.FRAME] @ table
        power.append((both[: media.BINS] ** 2 + both[media.BINS :] ** 2).tolist())
    of = lambda f, b: power[f][b] if 0 <= f < len(power) and 0 <= b < media.BINS else 0
    found = []
    for f in range(len(power)):
        here = []
        for b in range(media.BINS):
            p = power[f][b]
            if p > media.FLOOR and all(p > of(f, b - s) and p >= of(f, b + s) for s in (1, 2)) and p > of(f - 1, b) and p >= of(f + 1, b):
                here.append((-p, b))
        found += sorted((f, b) for _, b in sorted(here)[: media.PEAKS])
    codes = []
    for f, b in found:
        later = [(g, c) for g, c in found if g > f][: media.FAN]
        codes += [(f << 32) | (b << 16) | (c << 8) | (g - f) for g, c in later if g - f <= media.REACH]
    return sorted(codes)


def media_texts():
    draw = random.Random(5)
    long = "".join(chr(draw.randrange(32, 127)) for _ in range(media.AT_ONCE * media.HOP * 2 + 77))
    return ["", None, "a", "größe 日本 😀", "x" * 576, "x" * 577, "the quick brown fox " * 300, long, "a\x00b\n" * 200, "the quick brown fox " * 300]


def test_media_match_brute_force_and_come_back(spark):
    texts = media_texts()
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(None, "no id", None)])
    stored = media.store(docs, most=9000)
    got = {r.doc_id: r for r in stored.collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(r.media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        with wave.open(io.BytesIO(bytes(r.media))) as file:
            assert (file.getsampwidth(), file.getnchannels()) == (1, 1) and file.readframes(file.getnframes()) == payload
        expected = brute_landmarks(payload)
        assert r.landmarks == expected
        assert r.feature == f"{len(expected)}:{hashlib.sha256(np.array(expected, '<i8').tobytes()).hexdigest()}"
    assert got[6][1:] == got[9][1:] and got[0][1:] == got[1][1:]
    assert len(got[6].landmarks) > 20
    back = {r.doc_id: r.text for r in media.texts(stored).collect()}
    assert back == {**{i: t or "" for i, t in enumerate(texts)}, None: "no id"}
    # what stands beside a text changes nothing
    alone = media.store(documents(spark, [(6, texts[6], "en")]), keep=False).first()
    assert tuple(alone) == tuple(got[6])[:8]


def test_media_of_nothing(spark):
    assert media.store(documents(spark, [])).count() == 0


# ------------------------------------------------------------------ clusters


def brute_clusters(rows, k, rounds, dims, scale=64.0):
    good = [(i, [min(max(math.floor(x * scale), -(1 << 27)), 1 << 27) if abs(x * scale) < 2**60 else int(math.copysign(1 << 27, x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    marks = sorted((i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in good)
    centres = [v for _, _, v in marks[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in good:
            members.setdefault(nearest(v)[1], []).append(v)
        for n, those in members.items():
            centres[n] = [sum(column) // len(those) for column in zip(*those)]
    found = [(i, *nearest(v)[::-1]) for i, v in good]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    mark = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), mark(centres[n])) for i, n, d in found), key=str)


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, distance long")


def vector_rows(seed, n, dims):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(6, dims)) * 2
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + draw.normal(size=dims) * (0.05 if i % 3 else 1)]) for i in range(n)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (n, None), (n + 1, []), (n + 2, [1.0] * (dims - 1)), (n + 3, [None] * dims), (n + 4, [math.nan] * dims), (n + 5, [0.0] * dims), (n + 6, [math.inf] * dims)]
    return rows


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 6), (1, 1), (3, 0)])
def test_clusters_match_brute_force(spark, k, rounds):
    rows = vector_rows(6, 240, 8)
    found = centroids.cluster(vectors_table(spark, rows), k=k, rounds=rounds, dims=8).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == brute_clusters(rows, k, rounds, 8)
    if (k, rounds) == (5, 6):
        assert sum(r.scanned for r in found) < len(found) / 2


def test_clusters_of_few_vectors_and_extremes(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3e30, -3e30]), (4, [-1e-30, 0.0])]
    found = centroids.cluster(vectors_table(spark, rows), k=16, dims=2).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == brute_clusters(rows, 16, 3, 2)
    assert centroids.cluster(vectors_table(spark, [])).count() == 0
    assert centroids.cluster(vectors_table(spark, [(1, None)])).count() == 0


def test_bounds_never_change_a_cluster():
    draw = np.random.default_rng(8)
    v = draw.integers(-9, 10, size=(3000, 3))
    before, state = None, ()
    centres = v[:12].copy()
    for _ in range(8):
        cluster, upper, lower, scanned = centroids.Step.of(centres, before).assign(v, *state)
        d = centroids.distances(v, centres)
        assert (cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d.min(axis=1).astype(float))
        assert (upper >= own).all() and (lower <= np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float))).all()
        state, before = (cluster, upper, lower), centres
        centres = np.array([v[cluster == i].sum(axis=0) // max(1, (cluster == i).sum()) if (cluster == i).any() else centres[i] for i in range(12)])
    assert not scanned.all()
