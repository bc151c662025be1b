"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bm25, decontaminate, lines, merkle, pieces, pitman_yor, shards, spelling, subspaces, substrings, toxicity, url_filters
from .common import table

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _remainder(F.col("doc_id"), 7) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pitman_yor.score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_class")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) i FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) p FROM rep),
words AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(k, '')) kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.top_k(docs, docs.where(F.col("doc_id") % 20 == 0))


#: A public model file, read where the tokenizers are installed.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op5_pieces(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, pieces.load(model_path), keep=["doc_id"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shuffle_shards(table(spark, sf_dir, "documents"))
    return dealt.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.n_hit_words(F.col("hits")).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[i:i+9], ' ') s FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
starts AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) i FROM dw, ks WHERE len(w) >= k),
hits AS (SELECT doc_id, i, win.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') s FROM starts) d JOIN win USING (k, s)),
hit_words AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def _remainder(col, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labels outside the held-out fifth."""
    labels = table(spark, sf_dir, "labels").where(_remainder(F.col("doc_id"), 5) != 0)
    return toxicity.train(table(spark, sf_dir, "documents"), labels)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = toxicity_model(spark, sf_dir)
    scored = toxicity.with_scores(docs, model, keep=["doc_id", "lang"])
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), toxicity.rejects(model).alias("over_language_threshold"))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled page outcomes: pages and documents share their ids; bad: toxic, or of no quality."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _fits(rule_host: str, rule_path: str) -> str:
    return f"(host = '{rule_host}' OR ends_with(host, '.{rule_host}')) AND starts_with(path, '{rule_path}')"


_BY_LENGTH = sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))
_STRENGTH = "coalesce(least(greatest((mu*(1-mu) - spread) / greatest(spread - mu*(1-mu)*groups/n, 1e-9), 1.0), 1000.0), 1.0)"


def _strength_sql(level: str) -> str:
    return f"(SELECT {_STRENGTH} FROM (SELECT sum(bad)/sum(n) mu, sum(n*(bad/n)*(bad/n))/sum(n) - (sum(bad)/sum(n))*(sum(bad)/sum(n)) spread, count(*) groups, sum(n) n FROM {level} WHERE n > 0))"


OP10_SQL = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {UPPER_LOWER}) host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) path FROM pages),
flags AS (SELECT doc_id page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) bad FROM labels GROUP BY doc_id),
h AS (SELECT host, CAST(count(bad) AS DOUBLE) n, CAST(coalesce(sum(bad), 0) AS DOUBLE) bad,
             CASE WHEN len(string_split(host, '.')) > 1 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE host END AS domain,
             string_split(host, '.')[-1] suffix
      FROM u LEFT JOIN flags USING (page_id) GROUP BY host),
d AS (SELECT domain, suffix, sum(n) n, sum(bad) bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) n, sum(bad) bad FROM d GROUP BY suffix),
p AS (SELECT {_strength_sql("h")} m_host, {_strength_sql("d")} m_domain, {_strength_sql("s")} m_suffix,
             (SELECT coalesce(sum(bad)/nullif(sum(n), 0), 0.0) FROM s) mu),
s2 AS (SELECT suffix, (bad + m_suffix*mu)/(n + m_suffix) suffix_rate FROM s, p),
d2 AS (SELECT domain, (bad + m_domain*suffix_rate)/(n + m_domain) domain_rate FROM d JOIN s2 USING (suffix), p),
h2 AS (SELECT host, n + m_host + 1 size, (bad + m_host*domain_rate)/(n + m_host) rate FROM h JOIN d2 USING (domain), p),
v AS (SELECT page_id, host, path, rate - {url_filters.Z} * sqrt(rate*(1-rate)/size) bound FROM u JOIN h2 USING (host))
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in _BY_LENGTH)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _BY_LENGTH)} WHEN bound > {url_filters.MAX_BAD} THEN 'block' ELSE 'allow' END verdict
FROM v
"""


#: The fields that a leaf hashes.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id is tampered with in no case."""
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = merkle.leaf(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in LEAF))
    proved = merkle.manifest(docs, LEAF, "lang", "doc_id", doc_id=F.col("doc_id"), tampered=F.when(changed, tampered))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    found = proved.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY b) FROM range(256) r(b))"


def _crc32(text: str, crc: str = "crc") -> str:
    """The unsigned crc32 of a text's UTF-8 bytes; crc: a list of the 256 table entries."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    byte = "16 * (instr('0123456789ABCDEF', p[1]) - 1) + instr('0123456789ABCDEF', p[2]) - 1"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({pairs}, lambda p: CAST({byte} AS BIGINT))), lambda x, y: xor({crc}[(xor(x, y) & 255) + 1], x >> 8)), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    fields = (f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in LEAF)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP11_SQL = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} crc),
d AS (SELECT doc_id, coalesce('=' || lang, '') tree, {_leaf_sql("n_chars")} leaf, {_leaf_sql("n_chars + 1")} other,
             coalesce({_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) changed FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 slot FROM d),
up AS (SELECT 0 level, tree, slot, leaf node FROM r
  UNION ALL SELECT any_value(level) + 1, tree, slot // 2, sha256(string_agg(node, '' ORDER BY slot)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) n FROM up) WHERE n > 1 GROUP BY tree, slot // 2),
subs AS (SELECT tree, arg_max(node, level) subroot, max(level) height FROM up GROUP BY tree),
s AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 slot FROM subs),
top AS (SELECT 0 level, slot, subroot node FROM s
  UNION ALL SELECT any_value(level) + 1, slot // 2, sha256(string_agg(node, '' ORDER BY slot)) FROM (SELECT *, count(*) OVER () n FROM top) WHERE n > 1 GROUP BY slot // 2),
whole AS (SELECT arg_max(node, level) root, max(level) height FROM top),
steps AS (SELECT r.doc_id, r.tree, r.slot, l.level pos, ((r.slot >> l.level) & 1) side, n.node sib FROM r JOIN subs USING (tree) JOIN (SELECT CAST(range AS BIGINT) level FROM range(40)) l ON l.level < subs.height LEFT JOIN up n ON n.tree = r.tree AND n.level = l.level AND n.slot = xor(r.slot >> l.level, 1)
  UNION ALL SELECT r.doc_id, r.tree, r.slot, s.height + l.level, ((s.slot >> l.level) & 1), n.node FROM r JOIN s USING (tree) CROSS JOIN whole JOIN (SELECT CAST(range AS BIGINT) level FROM range(40)) l ON l.level < whole.height LEFT JOIN top n ON n.level = l.level AND n.slot = xor(s.slot >> l.level, 1)),
fold AS (SELECT tree, slot, 0 pos, CASE WHEN changed AND other IS NOT NULL THEN other ELSE leaf END node FROM r
  UNION ALL SELECT fold.tree, fold.slot, fold.pos + 1, sha256(CASE WHEN side = 1 THEN coalesce(sib, '') || node ELSE node || coalesce(sib, '') END) FROM fold JOIN steps ON steps.tree = fold.tree AND steps.slot = fold.slot AND steps.pos = fold.pos),
proof AS (SELECT tree, slot, sha256(coalesce(string_agg(sib, '' ORDER BY pos), '')) proof_sha256 FROM steps GROUP BY tree, slot),
folded AS (SELECT tree, slot, arg_max(node, pos) folded_root FROM fold GROUP BY tree, slot)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) proof_sha256, folded_root, folded_root = root verified
FROM r JOIN subs USING (tree) CROSS JOIN whole LEFT JOIN proof USING (tree, slot) JOIN folded USING (tree, slot)
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} crc),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {UPPER_LOWER}) run FROM documents),
counts AS (SELECT id, run, count(*) n FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY id, run),
hashed AS (SELECT run, n, {_crc32("id || ':' || run")} h FROM counts, crc),
spelled AS (SELECT CASE WHEN h % {spelling.DAMAGED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) n FROM spelled WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
cuts AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) short FROM (SELECT *, unnest(range(1, length(word) + 1)) i FROM v)),
same AS (SELECT a.word, b.word near, b.n near_n FROM cuts a JOIN cuts b ON a.short = b.short AND a.i = b.i AND a.word <> b.word),
less AS (SELECT DISTINCT a.word, b.word near, b.n near_n, a.n own_n FROM cuts a JOIN v b ON a.short = b.word),
pairs AS (SELECT * FROM same UNION SELECT word, near, near_n FROM less UNION SELECT near, word, own_n FROM less),
best AS (SELECT word, count(*) n_near, min(row(-near_n, near)) b FROM pairs GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN -b[1] >= {spelling.RATIO} * n THEN b[2] END form, CASE WHEN -b[1] >= {spelling.RATIO} * n THEN -b[1] END form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, word last, 0 k FROM f UNION ALL SELECT steps.word, f.form, k + 1 FROM steps JOIN f ON f.word = steps.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, k) root FROM steps GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) n_near, CAST(form_n AS BIGINT) form_n FROM f JOIN roots USING (word)
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspaces.near_vectors(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) x FROM embeddings),
ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach AS (SELECT vec_id a, vec_id b FROM v UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a vec_id, min(b) component_id FROM reach GROUP BY a),
n AS (SELECT a vec_id, count(*) n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) n_links, component_id, vec_id = component_id kept FROM c LEFT JOIN n USING (vec_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_near_dedup, op3_substring_dedup, op4_bm25_search, op5_pieces, op6_sharding, op7_line_dedup, op8_decontamination, op9_toxicity, op10_url_filters, op11_merkle, op12_spelling, op13_near_vectors)}


def oracle_sql() -> dict:
    return {"op3_substring_dedup": OP3_SQL, "op8_decontamination": OP8_SQL, "op10_url_filters": OP10_SQL, "op11_merkle": OP11_SQL, "op12_spelling": OP12_SQL, "op13_near_vectors": OP13_SQL}
