"""The named queries of this subpackage and, where SQL can state the answer, their oracles."""

import public_tokenizers
from pyspark.sql import functions as F

from . import (bpe, class_lm, decontaminate, exact_dedup, license_scan, pii, resampling, sharding, simhash, spelling,
               substring_dedup, toxicity, url_filter)
from .common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
QUERIES: dict = {}
ORACLES: dict = {}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 in SQL: its table of 256 by the rule, then one step per byte of the hexadecimal text.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS step)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode({text}))) // 2),
        lambda i: (16 * (instr('0123456789ABCDEF', hex(encode({text}))[2 * i + 1]) - 1)
            + instr('0123456789ABCDEF', hex(encode({text}))[2 * i + 2]) - 1)::BIGINT)),
        lambda c, b: xor(step[(xor(c, b) % 256 + 1)::INT], c // 256)))"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_label_propagation_shards")
def op1(spark, sf_dir):
    """All documents in shards 0 to 23 of equal counts; equal texts gather."""
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query("op2_golay_simhash")
def op2(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    classes = simhash.near_duplicate_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_rare_token_licenses")
def op3(spark, sf_dir):
    """Licence notices in every document."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


@query("op4_cuckoo_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents),
         g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""")
def op4(spark, sf_dir):
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


@query("op5_cgk_decontamination")
def op5(spark, sf_dir):
    """Benchmark items that stand in documents, with their edit distance."""
    return decontaminate.benchmark_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op6_counterfactual_toxicity")
def op6(spark, sf_dir):
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: Hosts whose pages make up the list that op7 blocks.
LISTED_HOSTS = r"(casino|bets|pills|ads-track|spam|adult)"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RULE = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_CASES = {what: " ".join(f"WHEN {_RULE.format(h=h, p=p)} THEN '{x}'" for verdict, h, p in
                         sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])) for x in [h + p if what == "rule" else verdict])
          for what in ("rule", "verdict")}


@query("op7_blocked_bloom_urls", f"""
    WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                         'abcdefghijklmnopqrstuvwxyz') AS host,
                      regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages),
         c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') AS canon FROM u),
         l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '{LISTED_HOSTS}'))
    SELECT page_id, host, path, CASE {_CASES['rule']} END AS rule,
           coalesce(CASE {_CASES['verdict']} END, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) AS verdict,
           canon IN (SELECT canon FROM l) AS listed FROM c""")
def op7(spark, sf_dir):
    """Every page's URL: rules, else the list of spam hosts' canonical URLs."""
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, url_filter.listing(pages, LISTED_HOSTS))


@query("op8_lexicon_bpe")
def op8(spark, sf_dir):
    """Every document encoded and decoded."""
    return bpe.encode_documents(read(spark, sf_dir, "documents"), TOKENIZER)


@query("op10_brown_class_lm")
def op10(spark, sf_dir):
    """Log probability of every document under the class model and the unigram base."""
    return class_lm.score_documents(read(spark, sf_dir, "documents"))


@query("op9_boosted_pii")
def op9(spark, sf_dir):
    """Personal data in every document."""
    return pii.personal_data(read(spark, sf_dir, "documents"))


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RESAMPLED = f"""
    WITH RECURSIVE {_CRC_TABLE},
         texts AS (SELECT doc_id AS id, row_number() OVER () AS r, 's' AS side, text FROM documents
                   UNION ALL SELECT item_id, row_number() OVER (), 't', text FROM benchmark),
         w AS (SELECT id, r, side, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM texts),
         f AS (SELECT id, r, side, len(w) AS n_words,
                      list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
         one AS (SELECT id, r, side, unnest(f) AS x FROM f),
         hashed AS (SELECT x, {_crc('x')} % 10000 AS bucket FROM (SELECT DISTINCT x FROM one), crc_table),
         n AS (SELECT side, bucket, count(*) AS n FROM one JOIN hashed USING (x) GROUP BY ALL),
         total AS (SELECT (SELECT coalesce(sum(n), 0) FROM n WHERE side = 's')::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM n WHERE side = 't')::DOUBLE AS t),
         gain AS (SELECT a.bucket, floor(1000 * ln(((coalesce(b.n, 0) + 1)::DOUBLE * (total.s + 10000)) / ((a.n + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS gain
                  FROM (FROM n WHERE side = 's') a LEFT JOIN (FROM n WHERE side = 't') b USING (bucket), total),
         mean AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM one JOIN hashed USING (x) JOIN gain USING (bucket) WHERE side = 's' GROUP BY r),
         scored AS (SELECT id AS doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                    + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || id::VARCHAR), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
                    FROM f LEFT JOIN mean USING (r) WHERE side = 's'),
         ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * 25 // 100 THEN k END AS rank FROM ranked
    UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < 20"""


@query("op12_importance_resampling", _RESAMPLED)
def op12(spark, sf_dir):
    """Every document's weight towards the benchmark, and the rank of the quarter that is drawn."""
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_NEAR_WORDS = f"""
    WITH RECURSIVE {_CRC_TABLE},
         runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
         codes AS (SELECT doc_id, run, count(*) AS m, {_crc("doc_id || ':' || run")} AS code FROM runs, crc_table GROUP BY doc_id, run, step),
         words AS (SELECT CASE WHEN code % 31 = 0 THEN left(run, code % length(run)) || substr(run, code % length(run) + 2) ELSE run END AS word,
                          sum(m)::BIGINT AS n FROM codes GROUP BY 1 HAVING length(word) >= 7 AND sum(m) >= 2),
         holes AS (SELECT word, n, i, left(word, i) || '*' || substr(word, i + 2) AS masked, left(word, i) || substr(word, i + 2) AS short
                   FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
         near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.masked = b.masked AND a.i = b.i AND a.word != b.word
                  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.short = b.word
                  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.short = b.word),
         best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
         told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
                         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
         chain AS (SELECT word, word AS root FROM told UNION SELECT chain.word, told.form FROM chain JOIN told ON chain.root = told.word AND told.form IS NOT NULL)
    SELECT told.word, form, root, n, n_near, form_n FROM told JOIN chain USING (word) WHERE root IN (SELECT word FROM told WHERE form IS NULL)"""


@query("op11_partenum_spelling", _NEAR_WORDS)
def op11(spark, sf_dir):
    """Every word of the documents with its near words, the word it is a variant of, and the end of that chain."""
    return spelling.spelling_groups(read(spark, sf_dir, "documents"))


@query("op13_fm_index_substrings", r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
         g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
         f AS (SELECT words, min(doc_id) AS first FROM g GROUP BY words),
         gone AS (SELECT DISTINCT r, i + k AS i FROM g JOIN f USING (words), range(13) AS o(k) WHERE doc_id > first),
         kept AS (SELECT r, i, w FROM (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (r, i)),
         body AS (SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM kept GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN body USING (r)""")
def op13(spark, sf_dir):
    """Every document without the passages of 13 words that stand in a document with a smaller id."""
    kept = substring_dedup.drop_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
