"""Queries of the training-data operators, and SQL for those that SQL can express.

Each query applies its operator to its whole table and derives the digest
columns that make results comparable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.byte_pairs import encode_and_decode_words
from glossa.llm.chat import collapse_and_render
from glossa.llm.collocations import collocations
from glossa.llm.decontaminate import contamination
from glossa.llm.infill import infill, restored
from glossa.llm.media import document_media
from glossa.llm.near_dedup import near_duplicates
from glossa.llm.pieces import encode_and_decode
from glossa.llm.quality import quality
from glossa.llm.shared import Workspace, read_table
from glossa.llm.token_rollup import Rollup, count_tokens, document_rollup
from glossa.llm.toxicity import toxicity
from glossa.llm.url_lists import host_of, judge, path_of
from glossa.llm.warc import archive_and_read

#: The vocabulary file's name; where the files lie is a parameter of the operator.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_VOCABULARY = "byte_bpe_50k.json"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored payload of every document, found through its page's media reference.

    One row for each row of documents. Null and empty texts are one row of
    padding; texts of any length are stored whole; equal texts give equal
    values; repeated rows and null ids pass through; other columns are ignored;
    an empty table gives none.
    """
    return document_media(read_table(spark, sf_dir, "documents"))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that no longer one begins with, rendered.

    Equal turns of a conversation are one; null turn numbers come first, null
    roles and texts are empty, rows without a conv_id are left out; turns of
    one number follow role and text. Conversations of more than 256 turns have
    several parts. Other columns are ignored; an empty table gives none.
    """
    return collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, read back from its archive through the index.

    One row for each row of pages. Null html is an empty payload, a null url
    about:blank, a null page_id revisits; rows that repeat the least page_id
    of a payload are all responses. Other columns are ignored; an empty table
    gives none.
    """
    return archive_and_read(read_table(spark, sf_dir, "pages"))


def op4_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, at a similarity of 85 in 100.

    One row for each row of documents. Texts without words, null ones too, link
    with nothing; ties at the threshold are links; rows that repeat a doc_id
    are linked each by its text, a null doc_id names no component. Other
    columns are ignored; an empty table gives none.
    """
    return near_duplicates(read_table(spark, sf_dir, "documents"), threshold_pct=85)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and what they decode to.

    One row for each row of documents. Null texts are as empty ones, with no
    ids; texts of any length are encoded whole; repeated rows and null ids pass
    through; other columns are ignored; an empty table gives none.
    """
    return encode_and_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def _dated_entries(pages: DataFrame) -> DataFrame:
    """Lists made from the pages' own hosts and paths: a number from each pattern's md5 gives its list and dates."""
    host, first = host_of(F.col("url")), F.element_at(F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != ""), 1)
    parent = F.regexp_extract(host, r"^[^.]*\.(.*)$", 1)
    each = [F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern")) for kind, pattern in (("host", host), ("domain", parent), ("path", F.concat(host, F.lit("/"), first)))]
    named = pages.select(F.explode(F.array(*each)).alias("e"))
    named = named.select("e.*").filter("pattern <> ''").distinct()
    named = named.withColumn("v", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")).filter("v % 3 <> 2")
    v = F.col("v")
    dated = ((F.lit("add"), v % 200), (F.lit("remove"), v % 200 + 20 + v % 71), (F.when(v % 5 == 0, "add").otherwise("remove"), v % 200 + 120))
    named = named.withColumn("d", F.explode(F.array(*[F.struct(action.alias("action"), day.alias("day")) for action, day in dated])))
    return named.select(F.when(F.col("v") % 4 == 0, "allow").otherwise("block").alias("list"), "kind", "pattern", "d.action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d.day").cast("int")).alias("at"))


def op5_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the list entries that are active when it is fetched.

    One row for each row of pages. Null and hostless URLs match nothing;
    repeated rows are judged each; of active patterns the longest decides, then
    the list and its name. Other columns are ignored; an empty table gives none.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    out = judge(pages.withColumn("fetched", fetched), _dated_entries(pages))
    return out.withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


#: Tokenizer versions of the rollup, by the vocabulary file they read.
ROLLUP_TOKENIZERS = ("byte_bpe_50k", "byte_bpe_multi_50k")


def rollup_tokenizers() -> dict[str, tuple[str, str]]:
    import public_tokenizers

    return {n: (tokenizer_path(f"{n}.tiktoken"), public_tokenizers.PATTERN) for n in ROLLUP_TOKENIZERS}


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents and tokens by source, language and tokenizer version, after four batches of deltas.

    Null sources and languages are keys of their own; null and empty texts have
    no tokens; rows that repeat a text are taken out again as copies, but for
    those of its least doc_id and those without one. Other columns are ignored;
    an empty table gives none.
    """
    docs, work = read_table(spark, sf_dir, "documents"), Workspace(spark, "token-rollup")
    counted = work.keep(count_tokens(docs, rollup_tokenizers()))
    totals = document_rollup(docs, rollup_tokenizers(), Rollup(spark, work.path("batches")), counted)
    work.free()
    return totals


def op8_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labels that are not held out.

    One row for each row of documents. Null and empty texts get the score of
    the bias; texts of any length are read whole; a doc_id with several labels
    is toxic if any is, null labels don't count; repeated rows are scored each,
    a null doc_id is held out. Other columns are ignored; an empty table gives
    none.
    """
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes, posterior and score of every document.

    One row for each row of documents. Null and empty texts are texts without
    words, which a labeller calls bad; texts of any length are read whole;
    repeated rows and null ids are scored each; other columns are ignored; an
    empty table gives none.
    """
    return quality(read_table(spark, sf_dir, "documents"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that are in windows of benchmark items.

    One row for each row of documents. Null and empty texts have no words and
    are never contaminated; texts of any length are read whole; repeated rows
    and null ids pass through; repeated items count once by id. Other columns
    are ignored; an empty table gives none, an empty benchmark no hits.
    """
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language.

    Null texts are as empty ones, a null lang is und; texts of any length are
    read whole; repeated rows count each; ties in score and count go by the
    phrase's bytes. Other columns are ignored; an empty table gives none.
    """
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and restored from that.

    One row for each row of documents. Null and empty texts, and texts that
    contain a sentinel, stay plain; texts of any length are read whole; repeated
    rows get the same cuts, a null doc_id those of an empty id. Other columns
    are ignored; an empty table gives none.
    """
    out = infill(read_table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte-level BPE ids of every document, and what they decode to.

    One row for each row of documents. Null texts are as empty ones, with no
    ids; texts of any length are encoded whole; repeated rows and null ids pass
    through; other columns are ignored; an empty table gives none.
    """
    return encode_and_decode_words(read_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_sequences": op1_media_sequences,
    "op2_snapshot_collapse": op2_snapshot_collapse,
    "op3_warc_index": op3_warc_index,
    "op4_chosen_path_dedup": op4_chosen_path_dedup,
    "op5_url_list_asof": op5_url_list_asof,
    "op6_sentencepiece_agenda": op6_sentencepiece_agenda,
    "op7_token_rollup": op7_token_rollup,
    "op8_toxicity_ftrl": op8_toxicity_ftrl,
    "op9_weak_label_quality": op9_weak_label_quality,
    "op10_winnowing": op10_winnowing,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_pairs": op13_byte_pairs,
}

ORACLE: dict[str, str] = {
    "op2_snapshot_collapse": """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, list(role || chr(31) || text ORDER BY turn NULLS FIRST, role, text) AS turns,
         list('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS pieces
  FROM t GROUP BY conv_id),
k AS (SELECT min(conv_id) AS conv_id, turns, any_value(n) AS n, count(*) AS n_copies, any_value(pieces) AS pieces FROM c GROUP BY turns),
kept AS (SELECT *, unnest(range(0, (n + 255) // 256)) AS part FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS other WHERE other.n > k.n AND other.turns[1:k.n] = k.turns))
SELECT conv_id, n AS n_turns, n_copies, part, array_to_string(pieces[part * 256 + 1:part * 256 + 256], '') AS rendered FROM kept
""",
    "op5_url_list_asof": r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INT AS fetched, row_number() OVER () AS r,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS steps
  FROM pages),
patterns AS (
  SELECT 'host' AS kind, host AS pattern FROM p UNION SELECT 'domain', regexp_extract(host, '^[^.]*\.(.*)$', 1) FROM p
  UNION SELECT 'path', host || '/' || steps[1] FROM p WHERE len(steps) > 0),
v AS (SELECT kind, pattern, ('0x' || md5(pattern)[1:6])::BIGINT AS v FROM patterns WHERE pattern <> ''),
dated AS (
  SELECT CASE WHEN v % 4 = 0 THEN 'allow' ELSE 'block' END AS list, kind, pattern, action, DATE '2024-01-01' + day::INT AS since FROM (
    SELECT *, 'add' AS action, v % 200 AS day FROM v UNION ALL SELECT *, 'remove', v % 200 + 20 + v % 71 FROM v
    UNION ALL SELECT *, CASE WHEN v % 5 = 0 THEN 'add' ELSE 'remove' END, v % 200 + 120 FROM v)
  WHERE v % 3 <> 2),
one AS (SELECT list, kind, pattern, since, bool_or(action = 'remove') AS removed FROM dated GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, kind, pattern ORDER BY since) AS until FROM one),
keys AS (
  SELECT r, fetched, 'host' AS kind, host AS pattern FROM p WHERE host <> ''
  UNION ALL SELECT r, fetched, 'domain', array_to_string((string_split(host, '.'))[i:], '.') FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
  UNION ALL SELECT r, fetched, 'path', host || '/' || array_to_string(steps[1:i], '/') FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM p WHERE host <> '')),
hit AS (
  SELECT r, k.kind, k.pattern, s.list, row_number() OVER (PARTITION BY r ORDER BY length(k.pattern) DESC, s.list <> 'block', s.list, k.pattern, k.kind) AS best,
         count(*) OVER (PARTITION BY r) AS n
  FROM keys k JOIN spans s ON s.kind = k.kind AND s.pattern = k.pattern AND NOT s.removed AND k.fetched >= s.since AND (s.until IS NULL OR k.fetched < s.until))
SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d') AS fetched, coalesce(h.n, 0)::BIGINT AS n_active, coalesce(h.list, 'none') AS verdict, h.pattern, h.kind
FROM p LEFT JOIN hit h ON h.r = p.r AND h.best = 1
""",
    "op3_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS least FROM p),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || h[i])::INT), 4, '0')), '') AS b FROM d)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(0, 5), lambda j: (b[5 * k + j + 1])::INT * (16 >> j)))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM bits
""",
    "op4_chosen_path_dedup": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM shared JOIN n na ON na.doc_id = u JOIN n nb ON nb.doc_id = v WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op10_winnowing": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
found AS (SELECT doc_id, item_id, p, dw.m FROM dw JOIN iw USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
""",
    "op11_collocations": rf"""
WITH p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, m, w[i:i + m - 1] AS ph, count(*) AS a FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) AS t(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * FROM g WHERE m > 1),
cut AS (
  SELECT c.lang, c.ph, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c JOIN g x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN g y ON y.lang = c.lang AND y.ph = c.ph[k + 1:c.m]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (
  SELECT lang, ph[i:i + j - 1] AS ph, max(a) AS longer FROM (
    SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c WHERE m > 2)) GROUP BY ALL),
free AS (
  SELECT b.*, array_to_string(b.ph, ' ') AS phrase FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.ph = b.ph
  WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * b.a::HUGEINT)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free JOIN words USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT % (length(text) + 1) AS a, ('0x' || h[9:16])::BIGINT % (length(text) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, substring(text, 1, least(a, b)) AS pre, substring(text, least(a, b) + 1, abs(a - b)) AS mid, substring(text, greatest(a, b) + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""",
}
