"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import automaton, language, mixing, negatives, quality, resampling, simhash, suffixes, tokencount, toxicity, urlfilter, vectors
from tidemark.llm.tables import held_out, table, tokenizer


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mix at the target weights takes every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the highest integer inner products for every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(rows, F.col("vec_id") % 50 == 0, k=5, scale=256)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 400-byte strings are gone, and which share over 50 words."""
    made = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, passage=51)
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    made = language.predict(docs.drop("lang"), language.fit(docs), keep_text=False)
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of what they decode to."""
    return automaton.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.token_counts(docs, tokenizer("byte_bpe_50k.json"), limit=1024)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label with cosine 0.98 or more."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, learned from labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


#: The rules that op11 is asked to apply.
URL_RULES = (
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule decides every page's url, and whether the page is allowed."""
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark's texts, and the rank of a quarter of the longer ones."""
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh has moved on to the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_top_k": op2_top_k,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_token_counts": op8_token_counts,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_url_filters": op11_url_filters,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256*CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id<>q.vec_id WHERE q.vec_id%50=0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
 SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM r WHERE k<=5""",
    "op11_url_filters": r"""WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN instr(url,'://')>0 THEN substr(url,instr(url,'://')+3) END AS rest FROM pages),
 h AS (SELECT *, coalesce(translate(regexp_extract(rest,'^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'') AS host, coalesce(regexp_extract(rest,'^[^/?#]*([^?#]*)',1),'') AS path,
 coalesce(regexp_extract(rest,'^[^/?#]*([^#]*)',1),'') AS tail FROM p),
 u AS (SELECT *, CASE WHEN host<>'' THEN host||tail END AS node, regexp_replace(html,'(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>','','g') AS clean FROM h),
 t AS (SELECT *, list_filter(regexp_extract_all(clean,'(?i)<link\b[^>]*>'), lambda x: regexp_matches(x,'(?i)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b'))[1] AS link,
 list_filter(regexp_extract_all(clean,'(?i)<meta\b[^>]*>'), lambda x: regexp_matches(x,'(?i)\shttp-equiv\s*=\s*["'']?\s*refresh\b'))[1] AS meta FROM u WHERE node IS NOT NULL),
 l AS (SELECT host, path, node, unnest([regexp_extract(link,'(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))',1)||regexp_extract(link,'(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))',2)||regexp_extract(link,'(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))',3),
 nullif(regexp_extract(meta,'(?i)\burl\s*=\s*([^"''>]+)',1),'')]) AS raw FROM t),
 k AS (SELECT host, path, node, trim(replace(raw,'&amp;','&')) AS link FROM l WHERE raw IS NOT NULL),
 w AS (SELECT node, CASE WHEN regexp_matches(link,'^(?i)https?://') THEN substr(link,instr(link,'://')+3) WHEN starts_with(link,'//') THEN substr(link,3)
 WHEN regexp_matches(link,'^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(link,'^(?:$|[#?])') THEN NULL WHEN starts_with(link,'/') THEN host||link
 ELSE host||CASE WHEN path='' THEN '/' ELSE regexp_replace(path,'[^/]*$','') END||link END AS whole FROM k),
 g AS (SELECT node AS a, translate(regexp_extract(whole,'^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')||regexp_extract(whole,'^[^/?#]*([^#]*)',1) AS b FROM w WHERE regexp_extract(whole,'^[^/?#]*')<>''),
 e AS (SELECT a, b FROM g WHERE a<>b UNION SELECT b, a FROM g WHERE a<>b),
 c AS (SELECT a AS node, a AS other FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a=c.other),
 r AS (SELECT * FROM (VALUES ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow')) AS x(rhost,rpath,rverdict)),
 o AS (SELECT DISTINCT other, regexp_extract(other,'^[^/?#]*') AS host, regexp_extract(other,'^[^/?#]*([^?#]*)',1) AS path FROM c),
 ov AS (SELECT other, arg_max(rverdict,length(rhost||rpath)) AS own FROM o JOIN r ON (host=rhost OR ends_with(host,'.'||rhost)) AND starts_with(path,rpath) GROUP BY other),
 cv AS (SELECT node, CASE WHEN bool_or(own='allow') THEN 'allow' ELSE 'block' END AS passed FROM c JOIN ov ON ov.other=c.other GROUP BY node)
 SELECT page_id, host, path, (SELECT arg_max(rhost||rpath,length(rhost||rpath)) FROM r WHERE (u.host=rhost OR ends_with(u.host,'.'||rhost)) AND starts_with(u.path,rpath)) AS rule,
 coalesce((SELECT arg_max(rverdict,length(rhost||rpath)) FROM r WHERE (u.host=rhost OR ends_with(u.host,'.'||rhost)) AND starts_with(u.path,rpath)),passed,'allow') AS verdict FROM u LEFT JOIN cv ON cv.node=u.node""",
    "op12_importance_resampling": r"""WITH crc AS (SELECT list(list_reduce([i]||range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
 d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
 df AS (SELECT n, unnest(w||list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) AS f FROM d),
 bf AS (SELECT unnest(w||list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) AS f FROM b),
 q AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
 k AS (SELECT f, xor(list_reduce([4294967295::BIGINT]||list_transform(range(CAST(length(x)/2 AS BIGINT)), lambda i: CAST('0x'||x[2*i+1:2*i+2] AS BIGINT)), lambda c, v: xor(c >> 8, tab[(xor(c,v) & 255)+1])), 4294967295)%10000 AS bucket FROM q, crc),
 s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY 1),
 g AS (SELECT bucket, CAST(floor(1000*ln(CAST(coalesce(t,0)+1 AS DOUBLE)*((SELECT sum(s) FROM s)+10000)/(CAST(coalesce(s,0)+1 AS DOUBLE)*((SELECT coalesce(sum(t),0) FROM t)+10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
 a AS (SELECT n, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE)/count(*)) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY n),
 r AS (SELECT doc_id, coalesce(n_features,0) AS n_features, coalesce(weight,0) AS weight, coalesce(len(w),0) AS words, CAST('0x'||sha256('7:'||doc_id)[1:8] AS BIGINT) AS h FROM d LEFT JOIN a USING (n)),
 z AS (SELECT *, weight+CAST(floor(-1000*ln(-ln((h+0.5)/4294967296))) AS BIGINT) AS score FROM r),
 p AS (SELECT *, row_number() OVER (PARTITION BY words>=20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words>=20) OVER () AS able FROM z)
 SELECT doc_id, n_features, weight, score, CASE WHEN words>=20 AND place<=floor(25*able/100) THEN place END AS rank FROM p""",
    "op13_hard_negatives": """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id%7=0 THEN (label+1)%10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256*CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label=b.label AS same, CAST(list_inner_product(a.e,b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id<>b.vec_id WHERE a.vec_id%100=0),
 p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k<=5),
 n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS k
 FROM p JOIN s ON s.anchor_id=p.anchor_id AND NOT same WHERE 80*positive_score<=100*score AND score<=positive_score)
 SELECT anchor_id, positive_id, CAST(k AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE k<=5""",
}
