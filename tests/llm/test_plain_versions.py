"""Toxicity, language, personal data, packing and winnowing against plain versions and planted cases."""

import functools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_id, packing, pii, queries, toxicity, winnow
from graphloom.plans.scratch import Scratch


def plain_terms(text):
    words = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = set()
    for w in words:
        out.add((0, w.encode()))
        out |= {(k, w.encode()[:size]) for k, size in enumerate(toxicity.PREFIXES, 1) if len(w.encode()) > size}
    return out


def test_terms_against_a_plain_tokenizer(prose, odd_texts):
    texts = [t for t in odd_texts if t is None or len(t) < 100] + [prose(40, 3), "A-b a_B 7up Überraschung überraschung", prose(12, 3)]
    buckets = {}
    for first, _, terms, bounds in toxicity.term_buckets(pa.array(texts, pa.string())):
        for i in range(len(bounds) - 1):
            buckets[first + i] = terms[bounds[i] : bounds[i + 1]].tolist()
    names = [plain_terms(t) for t in texts]
    assert [len(set(buckets[i])) for i in range(len(texts))] == [len(n) for n in names]
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            assert len(set(buckets[i]) & set(buckets[j])) == len(a & b)


def test_score_is_the_explicit_pair_sum():
    rng = np.random.default_rng(1)
    machine = toxicity.Machine(-0.3, np.zeros(toxicity.BUCKETS), np.zeros((toxicity.BUCKETS, 3)))
    used = rng.choice(toxicity.BUCKETS, 40, replace=False)
    machine.linear[used], machine.factors[used] = rng.normal(0, 0.5, 40), rng.normal(0, 0.5, (40, 3))
    rows = [rng.choice(used, n, replace=False) for n in (0, 1, 5, 12)] + [np.array([int(used[0]), (int(used.max()) + 1) % toxicity.BUCKETS])]
    got = machine.scores(np.concatenate(rows).astype(np.int64), np.cumsum([0, *map(len, rows)]))
    for row, score in zip(rows, got, strict=True):
        row = [t for t in row if machine.linear[t]]
        z = machine.base + sum(machine.linear[t] for t in row) + sum(machine.factors[a] @ machine.factors[b] for i, a in enumerate(row) for b in row[:i])
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_terms_that_tell_only_together(spark, make_docs):
    """Either word alone leaves the label open; the pair decides it."""
    rng = random.Random(4)
    rows = []
    for i in range(2500):
        kind = rng.randrange(4)
        words = [f"w{rng.randrange(300)}" for _ in range(25)] + ["alpha"] * (kind & 1) + ["omega"] * (kind >> 1)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(kind in (0, 3))))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.predict(make_docs([r[:2] for r in rows] + [(None, "alpha"), (7, rows[7][1])]), labels, queries.learns(5, 0)).collect()}
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95 and got[None].held_out


@functools.cache
def bucket(n, gram):
    return int(language_id.ngram_buckets([gram + "x"])[0][0][n - 2])


def plain_bayes(rows, texts):
    counts, docs = defaultdict(Counter), Counter()
    grams = lambda t: [bucket(n, "".join(c)) for n in (2, 3) for t2 in [("".join(x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in t)) + " "] for c in zip(*(t2[i:] for i in range(n)))]
    for t, lang in rows:
        counts[lang].update(grams(t))
        docs[lang] += 1
    out = []
    for t in texts:
        z = {lang: math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][g] + 0.5) / (sum(counts[lang].values()) + 0.5 * language_id.BUCKETS)) for g in grams(t)) for lang in counts}
        best = min(z, key=lambda x: (-z[x], x))
        out.append((best, 1 / sum(math.exp(v - z[best]) for v in z.values())))
    return out


def test_language_against_plain_bayes(spark, make_docs):
    """The scores of a plain classifier that counts the n-grams one by one."""
    rng = random.Random(2)
    letters = {"aa": "abcdefgh", "bb": "cdefghij", "cc": "efghijkl"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(4)), lang) for i in range(150) for lang in [rng.choice(list(letters))]]
    rows += [(3, rows[3][1], rows[3][2])] * 2 + [(None, "abc", "aa")]
    got = [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in language_id.predict(make_docs(rows), queries.learns(3, 1)).collect()]
    trains = [(t, lang) for i, t, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    want = {(i, t): p for (i, t, _), p in zip(rows, plain_bayes(trains, [t for _, t, _ in rows]), strict=True)}
    by_id = {i: p for (i, _), p in want.items()}
    assert len(got) == len(rows) and all(held for i, held, *_ in got if i is None)
    for i, _, lang, score in got:
        assert lang == by_id[i][0] and abs(score - by_id[i][1]) < 1e-3
    same = make_docs([(0, "abab", "xx"), (2, "abab", "yy"), (9, "abab", None)])
    assert {r.lang_pred for r in language_id.predict(same, F.col("doc_id") < 5).collect()} == {"xx"}


def plain_scores(seen, how):
    times, totals, seeds, prior = Counter(), Counter(), set(), {}
    rows = defaultdict(int)
    for row, instance, left, right, seed, p, left_n, right_n in seen:
        for pattern, n in ((f"l {left}", left_n), (f"r {right}", right_n)):
            if len(pattern) > 2:
                times[pattern, instance] += 1
                rows[row, pattern] = max(rows[row, pattern], n)
                prior[instance] = max(prior.get(instance, 0), p)
                seeds |= {instance} if seed else set()
    for (_, pattern), n in rows.items():
        totals[pattern] += n
    score, gained = dict(prior), {}
    for _ in range(how.rounds):
        found, n, support = Counter(), Counter(), Counter()
        for (pattern, instance), k in times.items():
            found[pattern] += score[instance] * k
            n[pattern] += k
            support[pattern] += score[instance] >= how.min_score
        good = {x: c for x in found if support[x] >= how.min_support and (c := found[x] / (max(totals[x], n[x]) + how.damping)) >= how.min_pattern}
        gained = {i: 1 - math.prod(1 - min(good[x], 0.999) for x, j in times if j == i and x in good) for i in prior}
        score = {i: 1.0 if i in seeds else max(prior[i], gained[i]) for i in prior}
    return {i: round(g, 9) for i, g in gained.items() if i not in seeds and g >= how.min_score}, {x: round(c, 9) for x, c in good.items()}


def test_scores_of_the_graph(spark):
    rng = random.Random(6)
    how = pii.Bootstrap(min_support=2, min_pattern=0.4, min_score=0.5)
    seen = []
    for i in range(400):
        left = rng.choice(["login:", "of", "key=", "the", ""])
        kind = rng.random()
        name = f"{'s' if kind < 0.7 else 'c'}{rng.randrange(25)}"
        if left in ("of", "the") and kind < 0.65:
            name = f"c{rng.randrange(25)}"
        seen.append((i % 90, name, left, rng.choice(["wrote", "and", ""]), name[0] == "s", 1.0 if name[0] == "s" else 0.8 if name == "c3" else 0.0, 1, 1))
    df = spark.createDataFrame(seen, "row long, instance string, left string, right string, seed boolean, prior double, left_n long, right_n long")
    found, good = pii.found_instances(df, how, Scratch(spark, "t"))
    want, patterns = plain_scores(seen, how)
    assert len(want) > 3 and {r.instance: round(r.score, 9) for r in found.collect()} == want
    assert {r.pattern: round(r.confidence, 9) for r in good.collect()} == patterns
    empty, _ = pii.found_instances(df.limit(0), how, Scratch(spark, "t"))
    assert empty.count() == 0


def test_planted_contexts(spark, make_docs):
    """Identifiers that no base pattern knows, behind labels that seeds share; numbers in prose stay."""
    rng = random.Random(12)
    prose = lambda n, seed: " ".join("".join(r.choice("abcdefghij") for _ in range(3 + r.randrange(5))) for r in [random.Random(seed)] for _ in range(n))
    labels, rows, planted = ["login:", "account is", "iban:", "token ="], [], {}
    for i in range(300):
        label = labels[i % 4]
        if label == "token =":
            own = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if i % 16 != 3 else f"Tk{rng.randrange(10**6)}x"
        else:
            own = f"user{i}@mail.org" if rng.random() < 0.65 else {"login:": f"jd{i}oe", "account is": f"ac-{rng.randrange(10**6)}", "iban:": f"DE{rng.randrange(10, 99)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}"}[label]
        shown = f'"{own}"' if label == "token =" else own
        rows.append((i, f"{prose(8, i)} {label} {shown} {prose(6, i + 1)}"))
        if "@" not in own:
            planted[i] = own
    rows += [(1000 + i, f"{prose(6, i)} in {1900 + i % 100} there were {i} of them, see 2.0 and x{i} {prose(5, i)}") for i in range(200)]
    texts = dict(rows)
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.all_spans if s["rank"] == 4] for r in pii.find(make_docs(rows)).collect()}
    caught = sum(planted[i] in got[i] for i in planted)
    wrong = sum(len([x for x in spans if planted.get(i) != x]) for i, spans in got.items())
    assert caught >= 0.95 * len(planted) and wrong <= 0.02 * len(planted), (caught, len(planted), wrong)
    clean = {r.doc_id: r.text for r in pii.redact(make_docs(rows)).collect()}
    assert sum(planted[i] in clean[i] for i in planted) <= 0.05 * len(planted) and clean[1000] == texts[1000]


def test_long_texts_are_linear():
    began = time.process_time()
    for text in ("key=value1 " * 450_000, "a:b@c.d," * 200_000, "= " * 700_000, "12 34 " * 300_000, "x" * 2_000_000 + "1@b.c"):
        spans = pii.base_spans(text)
        assert sum(1 for _ in pii.contexts(text, spans)) >= 0
        pii.redacted(text, [{"start": s, "rank": k, "end": e} for s, k, e in spans])
    assert time.process_time() - began < 100


def test_chunks_are_kept_within_bounds(prose):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    encoder = packing.ChunkEncoder(queries.tokenizer_path(), cached=300_000)
    whole = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    texts = [f"{'漢字' * 200}{i} " + "q9" * 300 + f" Word{i}, ÉTÉ! {prose(30, i)}" + "!" * 90 for i in range(150)]
    long = (prose(9000, 1) + " " + "z" * 3000 + "\n") * 30
    assert len(long) > packing.PART_CHARS
    for text, got in zip([*texts, long, " ", ""], encoder.encode([*texts, long, " ", ""]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert max(map(len, encoder.known)) <= packing.CACHED_CHARS
    assert encoder.size <= 2 * 300_000 + 500_000


def test_repeated_rows_are_dealt_apart(spark):
    cut = spark.range(9000).selectExpr("1L AS doc_id", "0L AS start", "100L AS length", "7L AS ids_crc32", "100L AS doc_tokens").repartition(3)
    got = packing.pack(cut, 256, 500).selectExpr("shiftright(sequence_id, 32) AS part").groupBy("part").count().collect()
    assert len(got) == 18 and max(r["count"] for r in got) < 700


def test_ranges_follow_the_size(spark, make_docs, monkeypatch, tmp_path, prose):
    docs = make_docs([(i, prose(20, i)) for i in range(60)])
    docs.write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    assert winnow.ranges_for(docs) == winnow.ranges_for(table) == 4
    want = sorted(map(tuple, winnow.compare_edited(table).collect()))
    monkeypatch.setattr(winnow, "RANGE_BYTES", 300)
    assert winnow.ranges_for(table) > 20
    assert sorted(map(tuple, winnow.compare_edited(table).collect())) == want
