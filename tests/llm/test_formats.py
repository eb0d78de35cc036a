"""WARC archives, SentencePiece, mixing and the pipeline."""

from __future__ import annotations

import gzip
import random
import re
import uuid

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from driftline.llm import common, mixing, pieces, warc
from driftline.llm import words as words_module
from driftline.llm.common import shared_dir, table
from tests.llm import brute

TEXTS = ["", " ", "a", " ▁ b▁▁c", "日本語 текст\n\n  \t x\r\n", "\x00\x01 é", "  lead", "trail  ", "▁", "😀😀 ok", "x" * 5000, "Hello, the WORLD of 1234 things."]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model()


def test_pieces_are_the_librarys_without_dropout(spark, sf_dir, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = pieces.PieceCodec(model, 0.0)
    for text in [t for t in TEXTS if "▁" not in t] + [r.text for r in table(spark, sf_dir, "documents").limit(60).collect()]:
        assert list(codec.encode(text)) == library.encode(text)


def naive(codec, library, text, doc_id):
    """Piece ids of a text and its candidates, word by word through ``brute.segment``."""
    pieces_of = {library.id_to_piece(i): library.get_score(i) for i in range(library.vocab_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    out, log = [], []
    words = re.findall(r"\n[^ \n]*| +[^ \n]*|[^ \n]+", " " + text) if text else []
    for place, word in enumerate(words):
        draw = codec.draws(doc_id, np.array([place]))
        values = words_module.mix64(draw[0:1] + np.arange(1, 4 * len(word) + 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        found, asked = brute.segment(word, pieces_of, int(codec.limit), lambda k, v=values: int(v[k]))
        for s in found:
            out += [library.piece_to_id(s)] if s in pieces_of else [int(codec.bytes[b]) for b in s.replace("▁", " ").encode()]
        log += asked
    return out, log


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.4])
def test_dropout_is_that_of_a_naive_agenda(model, rate):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = pieces.PieceCodec(model, rate, seed=3)
    rng = random.Random(1)
    texts = ["Hello, the WORLD of 1234 things.", "  lead and\n trail  \n\n", "日本語 текст é", "unbelievablyreorganising" * 4, "\n", "", " "]
    texts += ["".join(rng.choice("ab the\n ng,éo") for _ in range(rng.randrange(120))) for _ in range(30)]
    for k, text in enumerate(texts):
        found = codec.encode(text, k)
        assert found.tolist() == naive(codec, library, text, k)[0], text
        assert codec.decode(found) == text


def test_each_candidate_is_skipped_at_the_rate(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = pieces.PieceCodec(model, 0.1)
    seen = {}
    for doc in range(40):
        text = "the quick foxes were reorganising everything " * 5
        ids, log = naive(codec, library, text, doc)
        assert codec.encode(text, doc).tolist() == ids
        for piece, skip in log:
            seen.setdefault(piece, []).append(skip)
    often = [x for x in seen.values() if len(x) > 150]
    assert len(often) > 15
    assert all(abs(np.mean(x) - 0.1) < 5 * (0.09 / len(x)) ** 0.5 for x in often)


def test_occurrences_draw_for_themselves(model):
    codec = pieces.PieceCodec(model, 0.2, 1)
    text = "reorganising " * 400
    ids = codec.encode(text, 7)
    ways = {tuple(codec.encode(" reorganising", k).tolist()) for k in range(300)}
    assert len(ways) > 12 and len(ids) > len(pieces.PieceCodec(model, 0.0).encode(text))
    assert ids.tolist() != codec.encode(text, 8).tolist() and ids.tolist() == pieces.PieceCodec(model, 0.2, 1).encode(text, 7).tolist()
    assert ids.tolist() != pieces.PieceCodec(model, 0.2, 2).encode(text, 7).tolist()
    for t in TEXTS:
        assert codec.decode(codec.encode(t, 3)) == t
    with pytest.raises(ValueError, match="rate"):
        pieces.PieceCodec(model, 1.0)


def test_long_texts_are_encoded_in_parts(spark, model, monkeypatch):
    text = ("Some words,  two spaces \n and\nbreaks " * 400) + "y" * 3000 + " z" * 2000
    whole = pieces.PieceCodec(model, 0.1).encode_parts([text], [5], [0])[0]
    cut = pieces.parts_of(text, 1000)
    assert len(cut) > 10 and " ".join(cut) == text
    monkeypatch.setattr(pieces, "parts_of", lambda t, size=0: cut if t == text else [t])
    assert pieces.PieceCodec(model, 0.1).encode(text, 5).tolist() == whole.tolist()


def test_encode_and_decode_tables(spark, model):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no id"), (99, None), (5, TEXTS[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token_ids", F.lit("clash"))
    found = pieces.encode(df, model, seed=4)
    assert found.where("NOT lossless").count() == 0
    assert found.where("doc_id = 99").first().token_ids is None and found.where("doc_id = 0").first().token_ids == []
    assert found.where("n_tokens != coalesce(size(token_ids), 0)").where("token_ids IS NOT NULL").count() == 0
    back = sorted((str(r.doc_id), str(r.text)) for r in pieces.decode(found, model).collect())
    assert back == sorted((str(i), str(t)) for i, t in rows)
    assert pieces.encode(df.limit(0), model).count() == 0


def test_chunked_framing():
    for size in (0, 1, 4095, 4096, 4097, 20_000):
        payload = bytes(k * 31 % 256 for k in range(size))
        assert warc.dechunked(warc.chunked(payload)) == payload
    assert warc.dechunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_segments_in_any_order():
    assert warc.reassembled([(3, 6, b"ef"), (1, None, b"ab"), (2, None, b"cd")]) == b"abcdef"
    assert warc.reassembled([(1, None, b"ab")]) == b"ab"
    with pytest.raises(ValueError, match="total length"):
        warc.reassembled([(1, None, b"ab"), (2, 9, b"cd")])
    with pytest.raises(ValueError, match="missing or occurs twice"):
        warc.reassembled([(1, None, b"ab"), (3, 4, b"cd")])


def test_record_cut_short():
    whole = b"".join(r + b"\r\n\r\n" for r in warc.page_records(7, 0, "u\r\nX: y", b"z" * 40_000, "d", None, None))
    kinds = [(h["warc-type"], h.get("warc-segment-number")) for h, _ in warc.records_in(whole)]
    assert kinds == [("response", "1"), ("continuation", "2"), ("continuation", "3")]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records_in(whole[:-9]))


def test_warc_roundtrip(spark):
    long = "long é " * 30_000
    rows = [(1, "u", long), (2, "v", long), (2, "v", long), (3, None, None), (4, "w", ""), (5, "x", "s" * 99), (6, "x", "s" * 99), (7, "x", "t" * 100), (-8, "x", "t" * 100), (None, "n", long), (None, "n", "k" * 200), (9, "c", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"row": F.lit("r"), "digest": F.lit(0)}).repartition(3)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_roundtrip(df, path).collect())
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        refers = first.get(h) if h in first and first[h] != i else None
        want.append((str(i), len((h or "").encode()), brute.sha(h or ""), "response" if refers is None else "revisit", refers))
    assert found == sorted(want)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    archives = [gzip.decompress(f.content) for f in files]
    assert all(a.startswith(b"WARC/1.1\r\n") for a in archives)
    headers = [h for a in archives for h, _ in warc.records_in(a)]
    named = [h["warc-record-id"] for h in headers]
    assert len(named) == len(set(named)) and all(h["warc-refers-to"] in named for h in headers if h["warc-type"] == "revisit")
    assert warc.warc_roundtrip(df.limit(0), f"{path}-empty").count() == 0


def deviations(rows, weights):
    """The largest difference of blocks had from blocks due, over sources and slots, while on target."""
    slots = sorted({(r.slot, r.source) for r in rows if r.on_target})
    had, worst = {s: 0 for s in weights}, 0.0
    for t, (slot, source) in enumerate(slots):
        assert slot == t
        had[source] += 1
        worst = max(worst, *(abs(had[s] - w * (t + 1)) for s, w in weights.items()))
    return worst


@pytest.mark.parametrize(
    ("weights", "shares"),
    [
        ({"a": 0.9, "b": 0.05, "c": 0.05}, (0.9, 0.05, 0.05)),
        ({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, (1 / 3, 1 / 3, 1 / 3)),
        ({"a": 0.123456789, "b": 0.5, "c": 0.376543211}, (0.123456789, 0.5, 0.376543211)),
        ({"a": 7, "c": 3}, (0.7, 0, 0.3)),
    ],
)
def test_mixing_deviates_by_less_than_a_block(spark, weights, shares):
    """Over more than 10,000 slots of one document each."""
    counts = {"a": int(12_000 * shares[0]) + 9, "b": int(12_000 * shares[1]) + 9, "c": int(12_000 * shares[2]) + 9}
    rows = [(k * 10 + n, s) for n, s in enumerate(counts) for k in range(counts[s])]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"slot": F.lit("x"), "rank": F.lit(0)})
    found = mixing.mix(df, weights=weights, block=1).collect()
    assert len(found) == len(rows) and len({(r.slot, r.in_block) for r in found}) == len(rows)
    due = dict(zip("abc", shares, strict=True))
    assert all(r.release <= r.slot < r.deadline for r in found if due[r.source])
    on = [r for r in found if r.on_target]
    assert len(on) > 10_000
    assert deviations(on, {s: w for s, w in due.items() if w}) < 1
    idle = [r for r in found if not due[r.source]]
    assert len(idle) == (9 if 0 in shares else 0) and all(r.release is None and r.slot > max(x.slot for x in found if due[x.source]) for r in idle)


def test_slots_are_those_of_a_plain_simulation(spark, monkeypatch):
    counts = {f"s{k}": 3 + k * k for k in range(7)}
    rows = [(k * 10 + n, s) for n, s in enumerate(counts) for k in range(counts[s])]
    parts = [max(1, round(n**0.5)) for n in counts.values()]
    whole, had, want, t = sum(parts), [0] * 7, {}, 0
    while any((f"s{k}", j) not in want for k in range(7) for j in range(-(-counts[f"s{k}"] // 2))):
        ready = [(-(-(had[k] + 1) * whole // parts[k]), k) for k in range(7) if had[k] * whole // parts[k] <= t]
        k = min(ready)[1]
        want[f"s{k}", had[k]] = t
        had[k] += 1
        t += 1
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for chunk in (4, 512):
        monkeypatch.setattr(mixing.slots, "__defaults__", (chunk,))
        assert {(r.source, r.block_no - 1): r.slot for r in mixing.mix(df, block=2).collect()} == {k: v for k, v in want.items() if k[1] < -(-counts[k[0]] // 2)}


def test_mixing_of_many_sources(spark):
    rows = spark.range(2400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1200).alias("source"))
    found = mixing.mix(rows, block=1).collect()
    assert len({r.slot for r in found}) == 2400 and all(r.release <= r.slot < r.deadline for r in found)


def test_mixing_of_odd_rows(spark, monkeypatch):
    schema = "doc_id long, source string"
    rows = [(1, None), (None, "a"), (2, "a"), (2, "a"), (3, None)]
    for limit in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        found = mixing.mix(spark.createDataFrame(rows, schema), block=1).collect()
        assert sorted(str(r.doc_id) for r in found) == ["1", "2", "2", "3", "None"] and len({r.slot for r in found}) == 5
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert mixing.mix(spark.createDataFrame(rows, schema), weights={"zzz": 1}).count() == 5
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(spark.createDataFrame(rows, schema), weights={"a": -1})


def test_pipeline(spark, model):
    import corpus_pipeline
    from driftline.llm import toxicity

    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).where("toxic").collect()}
    left = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    texts = dict(left)
    distinct = [(i, texts[i]) for i, _, _, kept, _ in brute.exact_dedup(left) if kept]
    one = {i for i, _, c in brute.ngram_join(distinct) if i == c}
    assert set(final) == one and toxic and len(one) < len(distinct) < len(left)
    codec = pieces.PieceCodec(model, 0.0)
    assert all(r.lossless and codec.decode(r.token_ids) == texts[i] for i, r in final.items())


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, _place string, _doc_id int, _id double, whole string, place string, row string, of_id string"


def odd_docs(spark):
    base = " ".join(f"w{k}" for k in range(60))
    texts = [(1, base), (2, base + " end"), (2, "an unrelated text of its own that is here with an identifier used twice"), (3, "quite another one that stands alone in this table"), (None, None), (None, ""), (4, None), (5, "long " * 60_000), (5, "long " * 60_000), (6, base.upper())]
    return spark.createDataFrame([(i, t, None, None if i == 3 else "s", None, "p", 1, 0.5, "w", "q", "r", str(k)) for k, (i, t) in enumerate(texts)], ODD_DOCS)


@pytest.mark.parametrize(
    ("name", "stay"),
    [
        ("toxicity", range(10)),
        ("exact_dedup", [9, 1, 2, 3, {4, 5, 6}, {7, 8}]),
        ("ngram_jaccard_join", [{0}, 2, 3, 4, 5, 6, {7, 8}]),
        ("mixing", range(10)),
    ],
)
def test_stages_take_odd_rows_and_any_column(spark, sf_dir, name, stay):
    import corpus_pipeline

    docs = odd_docs(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, sf_dir)
    assert found.columns == docs.columns and found.schema.simpleString() == docs.schema.simpleString()
    left = sorted(int(r.of_id) for r in found.collect())
    groups = [{x} if isinstance(x, int) else x for x in stay]
    assert len(left) == len(groups) and all(len(g & set(left)) == 1 for g in groups)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_last_stage_takes_odd_rows(spark, sf_dir):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["sentencepiece"]
    found = stage(spark, odd_docs(spark), sf_dir)
    assert found.count() == 10 and found.where("lossless").count() == 10
    assert stage(spark, odd_docs(spark).limit(0), sf_dir).count() == 0


def test_pipeline_writes_in_the_order_of_the_mixture(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    found = stage(spark, docs, sf_dir)
    assert found.columns == docs.columns
    found.write.parquet(str(tmp_path / "mixed"))
    place = {r.doc_id: (r.slot, r.in_block) for r in mixing.mix(docs).collect()}
    order = []
    for file in sorted((tmp_path / "mixed").glob("part-*")):
        order += [place[r.doc_id] for r in spark.read.parquet(str(file)).coalesce(1).collect()]
    assert order == sorted(place.values())
