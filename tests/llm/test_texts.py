"""Winnowing, toxicity, language, personal data, packing and media against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, media, packing, pii, queries, toxicity, winnow
from graphloom.llm.winnow import Winnow


def test_winnow_against_plain(prose):
    how = Winnow(k=5, w=7)
    for text in ("", "a", "abcd", "abcdefgh", "ab" * 60, prose(80, 3), "😀" * 20 + "é"):
        codes = winnow.code_points(text)
        hashes = winnow.kgram_hashes(codes, how.k).tolist()
        want = []
        w = min(how.w, len(hashes))
        for i in range(len(hashes) - w + 1 if hashes else 0):
            window = hashes[i : i + w]
            at = max(j for j in range(w) if window[j] == min(window))
            if not want or want[-1] != (window[at], i + at):
                want.append((window[at], i + at))
        got = winnow.fingerprint(codes, how)
        assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in got] == want
    grams = winnow.kgram_hashes(winnow.code_points("abcabcabc"), 3)
    assert grams[0] == grams[3] == grams[6] and len(set(grams.tolist())) == 3


def test_shared_passage_is_found(prose):
    how = Winnow()
    passage = prose(60, 9)
    passage = passage[: how.k + how.w - 1]
    a, b = (winnow.fingerprint(winnow.code_points(prose(50, s) + passage + prose(70, s + 1)), how) >> np.uint64(32) for s in (1, 4))
    assert set(a.tolist()) & set(b.tolist())


def test_compare_edited(spark, make_docs, prose, odd_texts):
    rows = [(7 * i, t) for i, t in enumerate(odd_texts)] + [(1000 - i, prose(30 + i, i)) for i in range(40)]
    rows += [(2000, rows[20][1]), (2001, rows[20][1])]
    got = {r.doc_id: r for r in winnow.compare_edited(make_docs(rows).repartition(6)).collect()}
    assert len(got) == len(rows)
    rows.sort()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, other, nxt = (winnow.fingerprint(winnow.code_points(t), Winnow()) for t in (text, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (winnow.as_text(own), winnow.as_text(other))
        assert (r.near_edited, r.near_next) == (winnow.likeness(own, other), winnow.likeness(own, nxt))
    assert got[2000].near_next == 1.0 and got[2000].fingerprint == got[2001].fingerprint
    assert winnow.compare_edited(make_docs([])).count() == 0
    assert winnow.compare_edited(make_docs([(1, "abc")])).first().near_next == 1.0
    assert winnow.compare_edited(make_docs([(1, "abc"), (1, "abc"), (None, None), (2, "d" * 300)])).count() == 4
    assert winnow.fingerprints(make_docs(rows)).select("doc_id").distinct().count() == sum(bool(t) for _, t in rows)


def insults(n, seed):
    """Texts that are bad only where an insult meets a group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(40)]
        kind = rng.randrange(4)
        if kind & 1:
            words.insert(rng.randrange(40), "Dolts,")
        if kind & 2:
            words.insert(rng.randrange(40), "islanders")
        rows.append((i, " ".join(words), int(kind == 3)))
    return rows


def test_factorization_machine_learns_pairs(spark, make_docs):
    rows = insults(3000, 2)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows if i % 10 != 7] + [(5, None, "x")], "doc_id long, label int, text string")
    docs = make_docs([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in toxicity.predict(docs, labels, queries.learns(5, 0)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == {i for i, _ in held}
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.97
    kept = toxicity.drop_toxic(docs, labels, queries.learns(5, 0))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_toxicity_defined_results(spark, make_docs, odd_texts):
    docs = make_docs([(i, t) for i, t in enumerate(odd_texts)] + [(3, "twice"), (3, "twice")])
    none = spark.createDataFrame([], "doc_id long, label int")
    ones = spark.createDataFrame([(1, 1), (3, 1), (3, 0)], "doc_id long, label int")
    assert {r.score for r in toxicity.predict(docs, none, queries.learns(5, 0)).collect()} == {0.5}
    got = toxicity.predict(docs, ones, F.col("doc_id") >= 0).collect()
    assert len(got) == len(odd_texts) + 2 and len({r.score for r in got}) == 1 and got[0].score > 0.5
    assert toxicity.predict(make_docs([]), none, queries.learns(5, 0)).count() == 0


LANGUAGES = {"xx": "abcde", "yy": "fghij", "zz": "klmñé"}


def test_language(spark, make_docs, odd_texts):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(6)).title() for _ in range(30)), lang) for i in range(300) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd_texts)] + [(2000, "12 34 !?", "xx"), (2001, None, "yy")]
    got = {r.doc_id: r for r in language_id.predict(make_docs(rows), queries.learns(3, 1)).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:300])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    for i in (1000, 1001, 1002, 1009, 2000, 2001):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in language_id.predict(make_docs([(1, "abc", None), (2, "d", None)]), queries.learns(3, 1)).collect()} == {"und"}
    assert language_id.predict(make_docs([]), queries.learns(3, 1)).count() == 0


def test_ngrams_stay_inside_documents():
    alone, _, _ = language_id.ngram_buckets(["abc"])
    rows, starts, letters = language_id.ngram_buckets(["xy", "abc", "", "9z"])
    assert rows[starts[1] : starts[2]].tolist() == alone.tolist() and letters.tolist() == [2, 3, 0, 1]
    assert (alone[-1] == language_id.BUCKETS).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_against_patterns():
    rng = random.Random(4)
    pieces = ["a.b", "@", "x-y.zz", ".", " ", "+", "1", "23", "4539 1488 0343 6467", "4539148803436467", "192.168.1.1", "256.1.1.1", "1.2.3.4.5", "(555)", "-", "+1 (415) 555-2671", "00001.2.3.4", "é", "\n", "me@x.org", "@@", "_%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+" * 100_000, "1 " * 100_000):
        pii.base_spans(text)


def test_pii_finds_and_bootstraps(spark, make_docs, prose, odd_texts):
    rows = [(i, f"{prose(5, i)} login: user{i}@mail.org wrote {prose(5, i + 1)}") for i in range(12)]
    rows += [(100, f"{prose(4, 1)} login: qx-7781 wrote {prose(3, 2)}"), (101, f"{prose(4, 3)} of 7781 cows"), (102, "so qx-7781 again"), (103, "1.2.3.4 and 1.2.3.4"), (103, "1.2.3.4 and 1.2.3.4")]
    rows += [(200 + i, t) for i, t in enumerate(odd_texts)]
    docs = make_docs(rows)
    got = {}
    for r in pii.find(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in rows:
        for r in got[i]:
            base = plain_spans(text or "")
            assert r.base_sha256 == hashlib.sha256(pii.as_text(base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
            assert [s for s in r.spans.split(",") if s and not s.startswith("id:")] == [s for s in pii.as_text(base).split(",") if s]
    assert got[100][0].n_id == 1 and got[102][0].spans == "id:3:10" and got[101][0].n_id == 0 and len(got[103]) == 2
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[103] == "[IP] and [IP]" and texts[102] == "so [ID] again" and texts[200] is None and "@" not in texts[3]
    assert pii.find(make_docs([])).count() == 0 and pii.redact(make_docs([])).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(6)
    lengths = sorted((rng.randrange(1, 65) for _ in range(500)), reverse=True)
    open_, want = [], []
    for n in lengths:
        fits = [r for r in open_ if r[0] >= n]
        best = min(fits, key=lambda r: r[0])[0] if fits else None
        want.append(best if best is not None else 64)
        if best is None:
            open_.append([64])
            best_window = open_[-1]
        else:
            best_window = next(r for r in open_ if r[0] == best)
        best_window[0] -= n
    placed = packing.best_fit_decreasing(lengths, 64)
    assert [64 - at for _, at in placed] == want
    used = {}
    for (number, at), n in zip(placed, lengths, strict=True):
        assert at == used.get(number, 0)
        used[number] = at + n
    assert max(used.values()) <= 64 and len(used) == len(open_)


def test_packing(spark, make_docs, prose, odd_texts):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    texts = [*odd_texts, "it's 10 o'clock,\u00a0<|endoftext|> e\u0301 \u0301x\t\ty", *[prose(50 * i, i) for i in range(30)]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None)]
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(make_docs(rows), queries.tokenizer_path(), 1, 256).collect()
    windows, cut = {}, {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        cut.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        want = {(s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 256) for p in [ids[s : s + 256]]}
        assert cut[i] == want
    total = sum(r.length for r in got)
    assert len(windows) <= total / 256 * 1.1 + 2
    assert sum(r.doc_id == 0 for r in got) == 2
    assert packing.pack_documents(make_docs([]), queries.tokenizer_path()).count() == 0


def test_media_round_trip(spark, make_docs, odd_texts):
    rows = [(i, t) for i, t in enumerate(odd_texts)] + [(50, "a" * 64), (51, "a" * 65), (52, "a\x00"), (53, "a"), (54, "a")]
    got = {r.page_id: r for r in media.payload_sequences(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.encode(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.caption == f"Payload of document {i}" and r.position == 1
        length, samples = media.decode(stored)
        assert samples.tobytes()[:length] == raw and r.feature == media.feature(samples)
    assert got[53].feature == got[54].feature and got[52].n_bytes == 2
    assert media.payload_sequences(make_docs([])).count() == 0
    assert media.payload_sequences(make_docs([(None, "x"), (1, "x"), (1, "x")])).count() == 3
    with pytest.raises(ValueError):
        media.decode(media.encode(b"x")[:-1])


def test_interleaved_sequence(spark):
    html = """<html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body><p>One <b>bold</b><img src="a" alt="alt a"> two</p>
    <figure><img src="b" alt="x"><figcaption>Cap <i>b</i></figcaption></figure><figure><figcaption>Before</figcaption><video src="c"></video></figure><img alt="no source"><p>end"""
    items = media.parse(html)
    assert [i[1:] for i in items] == [("text", "T & t", None, None), ("text", "One bold", None, None), ("media", None, "a", "alt a"), ("text", "two", None, None), ("media", None, "b", "Cap b"), ("media", None, "c", "Before"), ("text", "end", None, None)]
    assert [i[0] for i in items] == list(range(7)) and media.parse(None) == [] and media.parse("<<>&") != None  # noqa: E711
    pages = spark.createDataFrame([(1, html, "k"), (2, None, "k"), (3, '<img src="zz">', "k")], "page_id long, html string, kind string")
    store = spark.createDataFrame([("a", 5), ("b", 6)], "reference string, size long")
    got = media.resolve(media.sequences(pages), store).where("kind = 'media'").orderBy("page_id", "position").select("page_id", "position", "reference", "size").collect()
    assert [tuple(r) for r in got] == [(1, 2, "a", 5), (1, 4, "b", 6), (1, 5, "c", None), (3, 0, "zz", None)]
