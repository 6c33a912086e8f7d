"""Queries over the test tables: one a operator, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import importance, language_id, license_scan, media, mixing, near_dup, packing, phrases, pii, substring_dedup, toxicity, url_reputation, winnow
from graphloom.llm.license_texts import KNOWN, SPELLINGS, WHOLE_DIGESTS
from graphloom.llm.mixing import Mix
from graphloom.llm.url_reputation import Rule


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX = Mix(
    levels=("domain", "lang", "source"),
    weights={"domain": {"web": 6, "books": 3, "code": 1}, "lang": {"en": 5, "de": 3, "fr": 2, "es": 2}, "source": {"src0": 2, "src7": 3}},
    percent=60,
    max_epochs=2,
    seed=7,
)


def mix_levels() -> dict[str, Column]:
    """Domain by the source's number: code for multiples of 5, books for the other multiples of 3, web for the rest."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    last = F.when(number != "", number.cast("bigint"))
    domain = F.when(last % 5 == 0, "code").when(last % 3 == 0, "books").otherwise("web")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", *(c.alias(n) for n, c in mix_levels().items()), mixing.tokens(F.col("text")).alias("n_tokens"))
    return mixing.select_prefixes(slim, MIX)


def _mix_sql() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in sorted(MIX.weights.get(level, {}).items()))
        return f"(CASE {cases} ELSE {MIX.default_weight} END)::HUGEINT" if cases else f"{MIX.default_weight}::HUGEINT"

    steps, above = [], "a0"
    for depth, level in enumerate(MIX.levels):
        up, here = ", ".join(["root", *MIX.levels[:depth]]), ", ".join(["root", *MIX.levels[: depth + 1]])
        i = depth + 1
        steps.append(f"""
 n{i} AS (SELECT {here}, sum(supply)::HUGEINT * {MIX.max_epochs} cap, {weight(level)} w FROM leaf GROUP BY ALL),
 m{i} AS (SELECT n.*, pool, coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s, sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ww
   FROM n{i} n JOIN {above} USING ({up}) WINDOW p AS (PARTITION BY {up} ORDER BY cap::DOUBLE / w::DOUBLE, {level})),
 f{i} AS (SELECT *, cap * ww <= (pool - s) * w fu FROM m{i}),
 g{i} AS (SELECT *, pool - sum(CASE WHEN fu THEN cap ELSE 0 END) OVER (PARTITION BY {up}) rest, sum(CASE WHEN fu THEN 0 ELSE w END) OVER (PARTITION BY {up} ORDER BY {level}) c1,
   sum(CASE WHEN fu THEN 0 ELSE w END) OVER (PARTITION BY {up}) ct FROM f{i}),
 a{i} AS (SELECT {here}, least(cap, CASE WHEN fu THEN cap ELSE (rest * c1)::HUGEINT // ct::HUGEINT - (rest * (c1 - w))::HUGEINT // ct::HUGEINT END) pool FROM g{i})""")
        above = f"a{i}"
    names = ", ".join(MIX.levels)
    return f"""
WITH src AS (SELECT doc_id, text, coalesce(lang, '(null)') lang, coalesce(source, '(null)') source, try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), '') AS BIGINT) nr FROM documents),
 doc AS (SELECT doc_id, CASE WHEN nr % 5 = 0 THEN 'code' WHEN nr % 3 = 0 THEN 'books' ELSE 'web' END "domain", lang, source,
   CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END n_tokens, '' root FROM src),
 leaf AS (SELECT root, {names}, sum(n_tokens)::BIGINT supply FROM doc WHERE n_tokens > 0 GROUP BY ALL),
 a0 AS (SELECT '' root, least(sum(supply)::HUGEINT * {MIX.max_epochs}, (sum(supply)::HUGEINT * {MIX.percent}) // 100) pool FROM leaf),{",".join(steps)},
 pl AS (SELECT {names}, supply, {above}.pool::BIGINT budget FROM {above} JOIN leaf USING ({names}) WHERE {above}.pool > 0),
 ep AS (SELECT doc_id, {names}, n_tokens, e.epoch::INTEGER epoch, budget - e.epoch * supply rest, md5(concat('{MIX.seed}:', e.epoch, ':', doc_id)) k
   FROM doc JOIN pl USING ({names}) CROSS JOIN range({MIX.max_epochs}) e(epoch) WHERE n_tokens > 0 AND e.epoch * supply < budget),
 ru AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {names}, epoch ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pos FROM ep)
SELECT doc_id, {names}, n_tokens::BIGINT n_tokens, epoch, least(n_tokens, rest - pos)::BIGINT take FROM ru WHERE pos < rest"""


RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]
Z, MAX_BAD = 1.645, 0.25


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that carries its id: bad where the label is 0."""
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = url_reputation.judge(_table(spark, sf_dir, "pages"), outcomes, RULES, Z, MAX_BAD)
    return judged.withColumns({c: F.round(c, 6) for c in ("posterior", "lower")})


def _url_sql() -> str:
    def case(what: str, otherwise: str) -> str:
        out = []
        for r in sorted(RULES, key=lambda r: (-len(r.target), r.target)):
            own, _, rest = r.target.partition("/")
            out.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}') THEN '{r.target if what == 'rule' else r.verdict}'")
        return f"CASE {' '.join(out)} ELSE {otherwise} END"

    two = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(string_split(site, '.')[-{n}:], '.')"
    own = f"regexp_matches(site, '{url_reputation.IPV4}') OR starts_with(site, '[')"
    prior_bad, prior_good = url_reputation.PRIOR

    def strength(name: str, table: str) -> str:
        return f"""{name} AS (SELECT 1 / greatest(0.001, least(0.5, coalesce(CASE WHEN coalesce(nn, 0) = 0 OR k < 2 OR m * (1 - m) = 0 THEN NULL
   ELSE (x2 - m * xx - m * (1 - m) * (k - 1)) / (m * (1 - m) * (nn - n2 / nn - (k - 1))) END, 0.001))) - 1 AS v
   FROM (SELECT *, xx::DOUBLE / nn m FROM (SELECT count(*) k, sum(n)::BIGINT nn, sum(bad)::BIGINT xx, sum(n::DOUBLE * n) n2, sum(bad::DOUBLE * bad / n) x2 FROM {table} WHERE n > 0)))"""

    return f"""
WITH seen AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path FROM pages),
 worst AS (SELECT doc_id, max(1 - quality)::BIGINT bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
 hn AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') site, count(bad) n, coalesce(sum(bad), 0)::BIGINT bad
   FROM seen LEFT JOIN worst ON page_id = doc_id GROUP BY host),
 hs AS (SELECT host, n, bad, CASE WHEN {own} THEN site WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END suffix,
   CASE WHEN {own} THEN site WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END dom FROM hn),
 ds AS (SELECT dom, suffix, sum(n)::BIGINT n, sum(bad)::BIGINT bad FROM hs GROUP BY ALL),
 ss AS (SELECT suffix, sum(n)::BIGINT n, sum(bad)::BIGINT bad FROM hs GROUP BY ALL),
 gs AS (SELECT (coalesce(sum(bad), 0)::BIGINT + {prior_bad}::DOUBLE) / (coalesce(sum(n), 0)::BIGINT + {prior_bad + prior_good}::DOUBLE) rate FROM hs),
 {strength("ks", "ss")}, {strength("kd", "ds")}, {strength("kh", "hs")},
 ps AS (SELECT suffix, (ks.v * rate + bad) / (ks.v + n) p FROM ss, gs, ks),
 pd AS (SELECT dom, (kd.v * p + bad) / (kd.v + n) p FROM ds JOIN ps USING (suffix), kd),
 ph AS (SELECT host, (kh.v * p + bad) / (kh.v + n) p, kh.v + n AS wt FROM hs JOIN pd USING (dom), kh),
 lo AS (SELECT host, p, p - {Z} * sqrt(p * (1 - p) / (wt + 1)) l FROM ph)
SELECT page_id, host, path, {case("rule", "NULL")} AS rule, {case("verdict", f"CASE WHEN l > {MAX_BAD} THEN 'block' ELSE 'allow' END")} AS verdict, round(p, 6) posterior, round(l, 6) "lower"
FROM seen LEFT JOIN lo USING (host)"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def _license_sql() -> str:
    """The notice rule line by line: a run of marked lines is a notice from its first line with a date or at a paragraph's head."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    margin, mark = "[ \\t\\r#*/;-]*", "(?:copyright|\\(c\\)|©)"
    dated = f"{mark}[ \\t,:-]*(?:\\(c\\)|©|copyright|[0-9]{{4}})"
    opening = "(permission is hereby granted|permission to use|redistribution and use)"
    words = "trim(regexp_replace(string_agg(kept, chr(10) ORDER BY i), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
    words = f"' ' || {words} || ' '"
    for spelling, usual in SPELLINGS.items():
        words = f"replace({words}, {quoted(spelling)}, {quoted(usual)})"
    bodies = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in KNOWN.items() for text in texts)
    whole = ", ".join(f"({quoted(digest)}, {quoted(name)})" for digest, name in WHOLE_DIGESTS.items())
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, lower(coalesce(text, '')) body FROM documents),
 bodies AS (SELECT 'doc' kind, r, NULL lic, body FROM docs
   UNION ALL SELECT 'line', r, NULL, ln FROM (SELECT r, unnest(string_split(body, chr(10))) ln FROM docs) WHERE regexp_matches(ln, 'licen[cs]e|licensing')
   UNION ALL SELECT 'known', NULL, name, lower(t.body) FROM (VALUES {bodies}) t(name, body)),
 texts AS MATERIALIZED (SELECT row_number() OVER () id, * FROM bodies),
 cut AS (SELECT id, string_split(body, chr(10)) ls, generate_subscripts(string_split(body, chr(10)), 1) i FROM texts),
 ln AS (SELECT id, i, ls[i] l, i = 1 OR regexp_full_match(ls[i - 1], '{margin}') AS head,
   regexp_matches(ls[i], '^{margin}{mark}') AND NOT regexp_matches(ls[i], '^{margin}(?:copyright[a-z]*[ \\t]+(?:holder|owner|notice)|\\(c\\)[ \\t]+you )') marked FROM cut),
 runs AS (SELECT *, sum(CASE WHEN marked AND NOT before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) run
   FROM (SELECT *, coalesce(lag(regexp_matches(l, '{opening}')) OVER (PARTITION BY id ORDER BY i), false) before FROM ln)),
 said AS (SELECT *, marked AND bool_or(marked AND (head OR regexp_matches(l, '^{margin}{dated}'))) OVER (PARTITION BY id, run ORDER BY i) notice FROM runs),
 rest AS (SELECT id, i, CASE WHEN NOT notice THEN l WHEN regexp_matches(l, '{opening}') THEN regexp_replace(l, '^.*?{opening}', '\\1') ELSE '' END l FROM said),
 kept AS (SELECT id, i, regexp_replace(l, '(^|[^\\p{{L}}\\p{{N}}]){dated}.*?{opening}', '\\1 \\2', 'g') kept FROM rest),
 canon AS (SELECT id, trim({words}) c FROM kept GROUP BY id),
 dg AS MATERIALIZED (SELECT kind, r, lic, sha256(c) dg FROM texts JOIN canon USING (id) WHERE kind <> 'known' OR c <> ''),
 known AS (SELECT dg, min(lic) lic FROM (SELECT dg, lic FROM dg WHERE kind = 'known' UNION ALL VALUES {whole}) GROUP BY dg),
 hits AS (SELECT r, count(*) n, array_to_string(list_sort(list(DISTINCT known.lic)), ',') names FROM dg JOIN known USING (dg) WHERE kind = 'line' GROUP BY r)
SELECT docs.doc_id, dg.dg canonical_sha256, known.lic license, coalesce(n, 0) n_notices, coalesce(names, '') notices
FROM docs JOIN dg ON dg.kind = 'doc' AND dg.r = docs.r LEFT JOIN known ON known.dg = dg.dg LEFT JOIN hits ON hits.r = docs.r"""


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


#: Every pair with a common shingle is counted on full sets; components by least-label propagation.
_NEAR_SQL = """
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws FROM documents),
 s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END sh FROM w),
 c AS MATERIALIZED (SELECT md5(array_to_string(list_sort(sh), chr(10))) k, min(doc_id) id, any_value(sh) sh FROM s WHERE len(sh) > 0 GROUP BY 1),
 x AS MATERIALIZED (SELECT id, len(sh) n, unnest(sh) t FROM c),
 l AS MATERIALIZED (SELECT a.id a, b.id b FROM x a JOIN x b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.id, b.id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
 e AS MATERIALIZED (SELECT a u, b v FROM l UNION ALL SELECT b, a FROM l),
 cc(node, label) USING KEY (node) AS (SELECT u, least(u, min(v)) FROM e GROUP BY u
   UNION SELECT r.node, y.l FROM (SELECT e.u node, min(cc.label) l FROM cc JOIN e ON e.v = cc.node GROUP BY e.u) y JOIN recurring.cc r ON r.node = y.node WHERE y.l < r.label)
SELECT s.doc_id, len(s.sh)::BIGINT n_shingles, coalesce(cc.label, c.id, s.doc_id) component_id, s.doc_id = coalesce(cc.label, c.id, s.doc_id) kept
FROM s LEFT JOIN c ON len(s.sh) > 0 AND c.k = md5(array_to_string(list_sort(s.sh), chr(10))) LEFT JOIN cc ON cc.node = c.id"""



def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(_table(spark, sf_dir, "documents"))


def learns(mod: int, held: int) -> Column:
    """Whether a doc_id is used for training: crc32 of its text form modulo ``mod`` is not ``held``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != held


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.predict(_table(spark, sf_dir, "documents"), labels, learns(5, 0))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"), learns(3, 1))



def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.payload_sequences(_table(spark, sf_dir, "documents"))
    return rows.selectExpr("page_id AS doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interleaved sequence of every page, with the document of its id as a figure."""
    rows = media.illustrated_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))
    return rows.select("page_id", "position", "kind", "text", "reference", "caption", "n_bytes", "payload_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, window=2048)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), span=50)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_REPEATS_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
 p AS MATERIALIZED (SELECT r, doc_id, i, w[i] word, CASE WHEN i + 49 <= len(w) THEN md5(array_to_string(w[i:i + 49], ' ')) END h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) i FROM d)),
 f AS MATERIALIZED (SELECT h, min(doc_id) least FROM p WHERE h IS NOT NULL GROUP BY h),
 c AS (SELECT r, i, word, max(CASE WHEN least < doc_id THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL gone FROM p LEFT JOIN f USING (h)),
 k AS (SELECT r, count(*) FILTER (gone) n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_removed, 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (r)"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _importance_sql() -> str:
    """Each different feature's checksum goes byte by byte through the table of the polynomial 0xEDB88320."""
    grams = "SELECT {id} id, unnest(CASE WHEN len(w) > 1 THEN list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END) g FROM {t}"
    split = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, {split} w FROM documents), b AS MATERIALIZED (SELECT {split} w FROM benchmark),
 tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) tb),
 dg AS MATERIALIZED ({grams.format(id="r", t="d")}), bg AS MATERIALIZED ({grams.format(id="0", t="b")}),
 u AS MATERIALIZED (SELECT g, hex(encode(g)) x FROM (SELECT g FROM dg UNION SELECT g FROM bg)),
 k AS MATERIALIZED (SELECT g, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, y: xor(c // 256, tb[xor(c % 256, y) + 1])), 4294967295) % 10000 bucket FROM u, tab),
 s AS (SELECT bucket, count(*) s FROM dg JOIN k USING (g) GROUP BY bucket), t AS (SELECT bucket, count(*) t FROM bg JOIN k USING (g) GROUP BY bucket),
 gn AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dg) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bg) + 10000)::DOUBLE)))::BIGINT gain FROM s LEFT JOIN t USING (bucket)),
 dw AS (SELECT id, count(*) n, sum(gain)::BIGINT z FROM dg JOIN k USING (g) JOIN gn USING (bucket) GROUP BY id),
 sc AS (SELECT r, doc_id, len(w) nw, coalesce(n, 0)::BIGINT n_features, coalesce((z - ((z % n) + n) % n) // n, 0)::BIGINT weight, floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT gu FROM d LEFT JOIN dw ON id = r),
 rk AS (SELECT r, row_number() OVER (ORDER BY weight + gu DESC, doc_id, r) k FROM sc WHERE nw >= 20)
SELECT doc_id, n_features, weight, weight + gu score, CASE WHEN k <= 25 * (SELECT count(*) FROM sc WHERE nw >= 20) // 100 THEN k END "rank" FROM sc LEFT JOIN rk USING (r)"""

def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, inside_percent=50)


_PHRASE_SQL = """
WITH p AS MATERIALIZED (SELECT coalesce(lang, 'und') lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') w
   FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece FROM documents)),
 g AS (SELECT lang, 1 k, unnest(w) ph FROM p UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
   UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p),
 f AS MATERIALIZED (SELECT lang, k, ph, count(*) f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT n FROM f WHERE k = 1 GROUP BY lang),
 c AS MATERIALIZED (SELECT lang, k, ph, f a, string_split(ph, ' ') w FROM f WHERE k > 1 AND f >= 10),
 x AS (SELECT c.lang, k, ph, a, cut, array_to_string(w[1:cut], ' ') lp, array_to_string(w[cut + 1:], ' ') rp FROM c, (VALUES (1), (2)) t(cut) WHERE cut < k),
 s AS (SELECT x.*, b.f l, d.f r, (1000000::HUGEINT * a * a) // (b.f::HUGEINT * d.f) score FROM x JOIN f b ON b.lang = x.lang AND b.ph = lp JOIN f d ON d.lang = x.lang AND d.ph = rp),
 best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
 inside AS (SELECT lang, ph, max(a) longer FROM (SELECT lang, array_to_string(w[1:2], ' ') ph, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
 kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, ph) WHERE longer IS NULL OR 100 * longer < 50 * a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) "rank" FROM kept)
SELECT lang, "rank", ph phrase, a, l, r, n, score::BIGINT score FROM ranked JOIN n USING (lang) WHERE "rank" <= 2000"""


QUERIES = {f.__name__: f for f in (op1_mixing, op2_media, op3_url_reputation, op4_winnow, op5_toxicity, op6_packing, op7_language_id, op8_pii, op9_near_dup, op10_license_scan, op11_substring_dedup, op12_importance, op13_phrases, media_pages)}
SQL = {"op1_mixing": _mix_sql(), "op3_url_reputation": _url_sql(), "op9_near_dup": _NEAR_SQL, "op10_license_scan": _license_sql(), "op11_substring_dedup": _REPEATS_SQL, "op12_importance": _importance_sql(), "op13_phrases": _PHRASE_SQL}
