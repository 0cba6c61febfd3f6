"""The operators as queries over whole given tables, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline
from plumbline.llm import language_id, license_scan, nearest_forest, quality_mil, secret_scan, toxicity_chain
from plumbline.llm.byte_pairs import decode, encode
from plumbline.llm.conversation_repair import repaired
from plumbline.llm.cross_tokenizer import align
from plumbline.llm.decontamination import contamination
from plumbline.llm.jaccard_join import jaccard_components
from plumbline.llm.minhash_dedup import near_duplicates
from plumbline.llm.tables import small_batches
from plumbline.llm.token_files import read_tokens, write_tokens
from plumbline.sources.folders import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(plumbline.__file__)))


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            small_batches(spark)
            spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)  # where the package isn't installed on the workers
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _components_sql(k: int, percent: int) -> str:
    """Components of documents by exact Jaccard similarity of k-word shingles."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= {k} THEN list_distinct(list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')))
                      WHEN len(words) >= 1 THEN [array_to_string(words, ' ')] ELSE [] END AS grams
  FROM w),
n AS (SELECT doc_id, len(grams) AS n, grams FROM s),
copies AS (SELECT min(doc_id) AS rep, any_value(n) AS n, grams FROM n WHERE n > 0 GROUP BY grams),
g AS (SELECT rep, n, unnest(grams) AS gram FROM copies),
hit AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM g a JOIN g b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM hit WHERE 100 * k >= {percent} * (na + nb - k)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep, rep AS other FROM copies UNION SELECT r.rep, b.b FROM reach r JOIN two b ON b.a = r.other),
least AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep)
SELECT n.doc_id, n.n AS n_shingles, coalesce(l.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN copies c ON n.n > 0 AND c.grams = n.grams LEFT JOIN least l ON l.rep = c.rep"""


@query("op5_ngram_jaccard_join", _components_sql(3, 90))
def op5(table):
    """Documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more, as components."""
    return jaccard_components(table("documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_benchmark_decontamination")
def op1(table):
    """Documents that hold a benchmark item, whole or edited, with the item and the place."""
    return contamination(table("documents"), table("benchmark"))


@query("op7_byte_bpe")
def op7(table):
    """Ids of every document by byte-level BPE, and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode(encode(table("documents").select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text"), path)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_token_files")
def op6(table):
    """Token files of all documents, written in ascending doc_id order and read back."""
    docs = table("documents")
    folder = fresh_folder(docs.sparkSession)
    write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    """The scan by plain matching of every rule on every text."""
    lists = []
    for i, r in enumerate(secret_scan.RULES):
        gap, whole, part = (f"{f}(t, {_sql(r.pattern)}{g})" for f, g in (("string_split_regex", ""), ("regexp_extract_all", ", 0"), ("regexp_extract_all", f", {r.group}")))
        lists.append(f"{gap} AS gap{i}, {whole} AS whole{i}, {part} AS part{i}")
    spans = []
    for i, r in enumerate(secret_scan.RULES):
        before = f"list_sum(list_transform(gap{i}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole{i}[1:i - 1], lambda x: length(x))), 0)"
        some = f"list_filter(range(1, len(whole{i}) + 1), lambda i: length(part{i}[i]) >= {r.least})"
        spans.append(f"list_transform({some}, lambda i: {{'s': ({before})::INT, 'k': {i}, 'e': ({before} + length(whole{i}[i]))::INT}}) AS s{i}")
    names = "[" + ", ".join(_sql(r.kind) for r in secret_scan.RULES) + "]"
    text = f"array_to_string(list_transform(list_sort(%s), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
    every = "list_concat(" * (len(spans) - 1) + "s0" + "".join(f", s{i})" for i in range(1, len(spans)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(lists)} FROM d),
s AS (SELECT doc_id, {', '.join(spans)} FROM m)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex,
       sha256({text % 'list_concat(list_concat(s0, s1), s2)'}) AS base_sha256, {text % every} AS spans
FROM s"""


@query("op4_secret_scan", _secrets_sql())
def op4(table):
    """Secrets in every document: counts of the base kinds, a digest of their places, and all places."""
    found = secret_scan.find_secrets(table("documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(secret_scan.BASE))
    of_kind = lambda i: F.size(F.filter("secrets", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def _licenses_sql() -> str:
    """Pieces between line ends, table cells and clauses; runs of neighbouring pieces of a sentence looked up among the known sentences."""
    known = license_scan.known_sentences()
    texts, names = (", ".join(map(_sql, x)) for x in (known.keys(), known.values()))
    firsts = ", ".join(_sql(x) for x in sorted({s.split()[0] for s in known}))
    longest = max(len(s.split()) for s in known)
    run = "run"
    for licence, ids in license_scan.rules():
        run = f"replace({run}, {_sql(''.join(f'<{i}>' for i in ids))}, '[{licence}]')"
    marked = "regexp_replace(translate(lower(coalesce(text, '')), '|;:', repeat(chr(10), 3)), '(gpl-[0-9][.][0-9])[+]', '\\1-or-later', 'g')"
    for pattern, sign in (
        (r"\bv\.[ \t\r\n]+([0-9])", r"v \1"),
        (r"[.!?]+($|[^a-z0-9_/.!?-])", r"|\1"),
        (r"(^|\n)[^a-z0-9\n|]*(rem|dnl|[0-9a-z][)])([ \t])", "\\1\n\\3"),
        (r"[^a-z0-9.|\n-]+", " "),
        (r"(^|[^a-z0-9])[.-]+", r"\1 "),
        (r"[.-]+($|[^a-z0-9])", r" \1"),
    ):
        marked = f"regexp_replace({marked}, {_sql(pattern)}, {_sql(sign)}, 'g')"
    return rf"""
WITH m AS (SELECT doc_id, {marked} AS t FROM documents),
p AS (SELECT doc_id, list_transform(string_split(t, '|'), lambda s: list_filter(list_transform(string_split(s, chr(10)),
        lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> '')) AS sentences FROM m),
s AS (SELECT doc_id, unnest(sentences) AS p, generate_subscripts(sentences, 1) AS nth FROM p),
f AS (
  SELECT doc_id, nth, p, list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_contains([{firsts}], split_part(p[i], ' ', 1)) THEN
    coalesce(list_max(list_filter(range(1, least({longest}, len(p) - i + 1) + 1), lambda k: list_contains([{texts}], array_to_string(p[i:i + k - 1], ' ')))), 0) ELSE 0 END) AS size
  FROM s),
e AS (
  SELECT doc_id, nth, list_reduce(list_prepend({{'i': 0::BIGINT, 'free': 0::BIGINT, 'run': ''}}, list_transform(range(1, len(p) + 1),
      lambda i: {{'i': i, 'free': i + size[i], 'run': CASE WHEN size[i] > 0 THEN '<' || [{names}][list_position([{texts}], array_to_string(p[i:i + size[i] - 1], ' '))] || '>'
                  WHEN len(p[i]) > 1 THEN '|' ELSE '' END}})),
    lambda a, x: CASE WHEN x.i < a.free THEN a ELSE {{'i': x.i, 'free': x.free, 'run': a.run || x.run}} END).run AS run
  FROM f),
j AS (SELECT doc_id, regexp_replace(coalesce(string_agg(run, '' ORDER BY nth), ''), '[|]+', '|', 'g') AS run FROM e GROUP BY doc_id),
r AS (SELECT doc_id, {run} AS run FROM (SELECT doc_id, coalesce(run, '') AS run FROM documents LEFT JOIN j USING (doc_id)))
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(run, '\[([^\]]+)\]', 1))), ',') AS licenses,
       array_to_string(regexp_extract_all(run, '<([^>]+)>', 1), ',') AS unmatched
FROM r"""


@query("op3_license_scan", _licenses_sql())
def op3(table):
    """Licences of every document by sentence rules."""
    return license_scan.find_licenses(table("documents").select("doc_id", "text")).select("doc_id", "licenses", "unmatched")


def _fold(parts: int):
    """Remainder of the id's checksum; null for null ids, which are neither learned from nor held out."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query("op2_quality_classifier")
def op2(table):
    """Quality of every document, learned from the labels of four fifths of them."""
    model = quality_mil.fit(table("documents"), table("labels").where(_fold(5) != 0))
    scored = quality_mil.score(table("documents").select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_language_id")
def op9(table):
    """Language of every document, learned from three quarters of them."""
    docs = table("documents")
    model = language_id.fit(docs.where(_fold(4) != 2))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(_fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op10_nearest_forest")
def op10(table):
    """The 20 nearest vectors by inner product for every twentieth vector."""
    return nearest_forest.search_forest(table("embeddings"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


@query("op8_toxicity_chain")
def op8(table):
    """Toxic documents with the probability of each category; labels of a fifth of the documents are not learned from."""
    names = [*toxicity_chain.SEEDS, "toxic"]
    model = toxicity_chain.fit(table("documents"), table("labels").where(_fold(5) != 0))
    scored = toxicity_chain.score(table("documents").select("doc_id", "text"), model, names)
    return scored.where("p_toxic >= 0.5").select("doc_id", *(f"p_{n}" for n in names), F.lit(1).alias("predicted"))


_KEPT_SQL = _components_sql(4, 80)


@query("op13_minhash_dedup", f"SELECT *, doc_id = component_id AS kept FROM ({_KEPT_SQL})")
def op13(table):
    """Documents whose 4-word shingle sets have a Jaccard similarity of 0.8 or more, as components of which one row stays."""
    return near_duplicates(table("documents"), k=4, percent=80)


@query("op11_cross_tokenizer")
def op11(table):
    """Tokens of two tokenizers over every document, aligned, with the corpus-wide counts of the id pairs that stand for each other."""
    return align(table("documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


#: The checksum bit by bit; then from the last row to the first the cheapest rest (least audit, and what it leaves) behind each state.
OP12_SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS mark
  FROM conversations),
checked AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(mark, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS part
  FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN part = 1 THEN '' WHEN part = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM checked, range(CASE WHEN part = 3 THEN 2 ELSE 1 END)
  WHERE part <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last_sign, left(role, 1) AS c
  FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM ordered),
judged AS (
  SELECT *, CASE WHEN last_sign = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN last_sign NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         coalesce(lag(c) OVER w || c NOT IN ('su', 'ua', 'au'), false) AS wrong
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (wrong) AS illegal
  FROM judged GROUP BY conv_id),
plan AS (
  SELECT conv_id, n + 1 AS i, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0, {'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS s1,
         {'c': 3::BIGINT, 'a': 'I', 't': ['assistant:']} AS s2, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, i,
    list_sort([d0, k0, r0, u2])[1], list_sort([d1, k1, r1, v2])[1], list_sort([d2, k2, r2, w2])[1], list_sort([d3, k3, r3, x2])[1]
  FROM (
    SELECT *,
      {'c': 3 + after_2.c, 'a': 'I' || after_2.a, 't': list_prepend('user:', after_2.t)} AS u2, u2 AS v2,
      {'c': 3 + least_3.c, 'a': 'I' || least_3.a, 't': list_prepend('assistant:', least_3.t)} AS w2,
      {'c': 3 + least_2.c, 'a': 'I' || least_2.a, 't': list_prepend('user:', least_2.t)} AS x2
    FROM (
      SELECT *, list_sort([d2, k2, r2])[1] AS least_2, list_sort([d3, k3, r3])[1] AS least_3,
        list_sort([list_sort([d2, k2, r2])[1], {'c': 3 + list_sort([d3, k3, r3])[1].c, 'a': 'I' || list_sort([d3, k3, r3])[1].a,
                   't': list_prepend('assistant:', list_sort([d3, k3, r3])[1].t)}])[1] AS after_2
      FROM (
        SELECT conv_id, j.i,
          {'c': 4 + s0.c, 'a': 'D' || s0.a, 't': s0.t} AS d0, {'c': 4 + s1.c, 'a': 'D' || s1.a, 't': s1.t} AS d1,
          {'c': 4 + s2.c, 'a': 'D' || s2.a, 't': s2.t} AS d2, {'c': 4 + s3.c, 'a': 'D' || s3.a, 't': s3.t} AS d3,
          CASE WHEN stay AND c = 's' THEN {'c': more + s1.c, 'a': 'K' || s1.a, 't': list_prepend(own, s1.t)}
               WHEN stay AND c = 'u' THEN {'c': more + s2.c, 'a': 'K' || s2.a, 't': list_prepend(own, s2.t)} ELSE never END AS k0,
          CASE WHEN stay AND c = 'u' THEN {'c': more + s2.c, 'a': 'K' || s2.a, 't': list_prepend(own, s2.t)} ELSE never END AS k1,
          CASE WHEN stay AND c = 'a' THEN {'c': more + s3.c, 'a': 'K' || s3.a, 't': list_prepend(own, s3.t)} ELSE never END AS k2,
          CASE WHEN stay AND c = 'u' THEN {'c': more + s2.c, 'a': 'K' || s2.a, 't': list_prepend(own, s2.t)} ELSE never END AS k3,
          CASE WHEN stay THEN {'c': 3 + more + s2.c, 'a': 'R' || s2.a, 't': list_prepend('user:' || text, s2.t)} ELSE never END AS r0, r0 AS r1, r0 AS r3,
          CASE WHEN stay THEN {'c': 3 + more + s3.c, 'a': 'R' || s3.a, 't': list_prepend('assistant:' || text, s3.t)} ELSE never END AS r2
        FROM (
          SELECT p.*, j, j.text AS text, j.c AS c, j.role || ':' || j.text AS own, j.fault IN ('', 't') AS stay, CASE j.fault WHEN 't' THEN 3 ELSE 0 END AS more,
                 {'c': 1000000000000::BIGINT, 'a': '', 't': []::VARCHAR[]} AS never
          FROM plan p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i - 1)))))
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(p.s0.c, 0) AS cost, coalesce(p.s0.a, '') AS audit,
       sha256(coalesce(array_to_string(p.s0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) s
LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.i = 1"""


@query("op12_conversation_repair", OP12_SQL)
def op12(table):
    """Every conversation after damage: its faults, the cheapest repair and a digest of what is left."""
    return repaired(table("conversations"))
