"""Queries over questions, messages and documents' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.registry import query
from tidemark.sources.roles import table

TEMPLATES = [
    "fields up to {n} m from the river that look odd",
    "a new kiln or dumping by the river this year, {n} m either side",
    "built-up land by the stream since 2016, {n} m",
    "did the  river overflow its banks within 0.{n} km",
    "map the river from source to mouth",
    "what became of the corridor of {n} m, decade by decade",
    "is the wheat thirsty",
    "which fields to visit first",
    "river corridors of 25 m, {n}m and 1.5 km in 1975, 1984 to 2030 and 2016",
    "Do radar and optical agree?",
    "NDVI trend here",
    "scan plot {n}",
    "green trees along the river",
    "qila river please",
    "what is this",
    "nadi in 1990, 2001, 2010 and 2020",
]


def pick(options: list[str], key: str, number: str) -> Column:
    """One of the options for each row by its key, with the row's number filled in."""
    one = F.element_at(F.array(*map(F.lit, options)), (F.col(key) % len(options) + 1).cast("int"))
    return F.replace(one, F.lit("{n}"), F.col(number).cast("string"))


def pick_sql(options: list[str], key: str, number: str) -> str:
    quoted = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"replace(list_extract([{quoted}], CAST({key}%{len(options)}+1 AS INT)), '{{n}}', CAST({number} AS VARCHAR))"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, question): a question for every part."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), pick(TEMPLATES, "p_partkey", "p_size").alias("question"))


QUESTIONS = f"qs AS (SELECT p_partkey AS id, {pick_sql(TEMPLATES, 'p_partkey', 'p_size')} AS question FROM part), q AS (SELECT id, question, trim(regexp_replace(lower(question),'\\s+',' ','g')) AS q FROM qs)"
DIST_SQL = "list_transform(list_zip(regexp_extract_all(q,'(\\d+(?:\\.\\d+)?)\\s*(km|kilomet(?:er|re)s?|m|met(?:er|re)s?)\\b',1), regexp_extract_all(q,'(\\d+(?:\\.\\d+)?)\\s*(km|kilomet(?:er|re)s?|m|met(?:er|re)s?)\\b',2)), lambda x: CAST(x[1] AS DOUBLE)*CASE WHEN x[2] LIKE 'k%' THEN 1000.0 ELSE 1.0 END)"
YEARS_SQL = "list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(q,'\\b(19[89]\\d|20[0-4]\\d)\\b',1), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1984 AND 2026)))"


@query(f"SELECT id, array_to_string({DIST_SQL},',') AS metres FROM q", QUESTIONS)
def parse_distances(spark: SparkSession, sf: str) -> DataFrame:
    d = T.distances(T.tidy(F.col("question")))
    return questions(spark, sf).select("id", F.concat_ws(",", d.cast("array<string>")).alias("metres"))


@query(f"SELECT id, array_to_string({YEARS_SQL},',') AS years FROM q", QUESTIONS)
def parse_years(spark: SparkSession, sf: str) -> DataFrame:
    y = T.years(T.tidy(F.col("question")), 2026)
    return questions(spark, sf).select("id", F.concat_ws(",", y.cast("array<string>")).alias("years"))


def action_sql() -> str:
    has = lambda w: f"regexp_matches(q,'{w}')"
    river = has(T.RIVER)
    rules = [(has("qila|kila|quila"), "qila"), (f"{river} AND {has(T.FIELDS)}", "river_fields"), (has(T.FLOOD), "river_flood")]
    rules += [(f"{river} AND {has(w)}", n) for n, w in T.RIVER_ACTIONS]
    rules += [(f"{river} AND len({DIST_SQL})>=2", "river_ladder"), (f"{river} AND ({has(T.HISTORY)} OR len({YEARS_SQL})>=3)", "river_timeline"), (river, "river_change")]
    rules += [(has(w), n) for n, w in T.OTHER_ACTIONS]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in rules) + " ELSE 'help' END"


@query(f"SELECT id, {action_sql()} AS action FROM q", QUESTIONS)
def parse_question_action(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("id", T.action(F.col("question"), 2026).alias("action"))


LATEST = 2025  # the latest complete season, a year before the last that a question may name


@query(
    f"""WITH d AS (SELECT id, {DIST_SQL} AS d, {YEARS_SQL} AS y FROM q), p AS (SELECT id, d, CASE WHEN len(y)>=2 OR (len(y)=1 AND y[1]<{LATEST}) THEN y[1] ELSE 2017 END AS a0, CASE WHEN len(y)>=2 THEN y[len(y)] ELSE {LATEST} END AS b0 FROM d),
 c AS (SELECT *, least(b0,{LATEST}) AS b, greatest(a0,1990) AS a FROM p)
 SELECT id, CAST(least(greatest(CASE WHEN len(d)>0 THEN d[1] ELSE 250 END,10),2000) AS INT) AS corridor, CAST(CASE WHEN a>=b THEN b-1 ELSE a END AS INT) AS year_a, CAST(b AS INT) AS year_b,
 concat_ws('; ', CASE WHEN b0>{LATEST} THEN b0||' moved to {LATEST}' END, CASE WHEN a0<1990 THEN a0||' moved to 1990' END, CASE WHEN a>=b THEN 'start moved to '||(b-1) END) AS notes FROM c""",
    QUESTIONS,
)
def question_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """the corridor and the pair of years of a question, clamped, with defaults, and what was moved."""
    q = T.tidy(F.col("question"))
    d = questions(spark, sf).select("id", T.corridor(q, 250.0).alias("corridor"), T.year_pair(T.years(q, 2026), 2017, LATEST).alias("p"))
    return d.select("id", "corridor", "p.year_a", "p.year_b", "p.notes")


# Which words name which reach, in the order in which they are tried.
REACHES = (("lower", ("lower", "mouth", "overflow")), ("urban", ("built-up", "urban", "kiln")), ("upper", ("source", "upper", "wheat")))


@query(
    "SELECT id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(q,'{w}')" for w in words) + f" THEN '{name}'" for name, words in REACHES) + " END AS reach FROM q",
    QUESTIONS,
)
def parse_reach(spark: SparkSession, sf: str) -> DataFrame:
    """the first reach that has a word in the question."""
    q, reach = T.tidy(F.col("question")), None
    for name, words in REACHES:
        hit = F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w))  # noqa: B023
        reach = F.when(hit, name) if reach is None else reach.when(hit, name)
    return questions(spark, sf).select("id", reach.alias("reach"))


MESSAGES = [
    "HTTP response code: 403 for {n}",
    "HTTP error code: 404",
    "Request for 1-2 failed with response_code=503",
    "Operation too slow after {n} s, response_code=206",
    "response_code=206, msg=Operation timed out after {n} ms",
    "Could not resolve host: a.b",
    "got 10 bytes, expected {n}",
    "ZIPDecode: error at scanline {n}",
    "response_code=206",
    "HTTP response code on x{n}.tif: 500",
    "something odd {n}",
    "HTTP response code: 429",
    "Read failed. response_code=0",
    "HTTP error code for x.tif range 0-99: 502. Retrying",
    "HTTP response code: 404 after response_code=206 and HTTP error code: 418",
    "503: busy",
    "HTTP response code: 418, response_code=451",
    "read failed",
]
HREF = "CASE id%5 WHEN 0 THEN TIMESTAMP '2024-01-10' WHEN 1 THEN TIMESTAMP '2024-02-10' END"


@query(
    f"""WITH m AS (SELECT event_id AS id, {pick_sql(MESSAGES, 'event_id', 'user_id')} AS m FROM events),
 c AS (SELECT id, m, {HREF} AS expiry, list_transform(flatten([{', '.join(f"regexp_extract_all(m,'{p}',1)" for p in T.STATUS)}]), lambda x: CAST(x AS INT)) AS c FROM m),
 s AS (SELECT *, coalesce(list_filter([{', '.join(map(str, T.STATUS_RANK))}], lambda x: list_contains(c,x))[1], list_min(list_filter(c, lambda x: x>=400)), CASE WHEN list_contains(c,0) THEN 0 WHEN list_contains(c,206) THEN 206 END) AS status FROM c)
 SELECT id, CAST(status AS INT) AS status, CASE WHEN expiry<=TIMESTAMP '2024-01-15' AND (status IS NULL OR status=403) THEN 'expired' """
    + " ".join(f"WHEN status={c} THEN '{k}'" for c, k in T.STATUS_KIND.items() if c >= 400)
    + " WHEN status>=500 THEN 'server' WHEN status>=400 THEN 'io' "
    + " ".join(f"WHEN regexp_matches(m,'{p}') THEN '{k}'" for k, p in T.MESSAGE_KINDS)
    + " WHEN status=0 THEN 'network' WHEN status=206 THEN 'truncated' WHEN m LIKE '%odd%' THEN 'error' ELSE 'io' END AS kind FROM s"
)
def classify_error(spark: SparkSession, sf: str) -> DataFrame:
    """a failed read's status and kind: of all statuses named the one that ranks first, an expired address, wordings."""
    m = table(spark, sf, "events").select(F.col("event_id").alias("id"), pick(MESSAGES, "event_id", "user_id").alias("m"))
    day = F.when(F.col("id") % 5 == 0, "2024-01-10").when(F.col("id") % 5 == 1, "2024-02-10").cast("timestamp")
    m = m.withColumn("status", T.read_status(F.col("m")))
    kind = T.read_kind(F.col("m"), F.col("status"), day, F.lit("2024-01-15").cast("timestamp"), ~F.col("m").contains("odd"))
    return m.select("id", "status", kind.alias("kind"))


TOLD = "'GDAL on https://h.example/a/'||page_id||'/T44_B03.tif?sv=1&sig=q%3D said: zq%2Bx%3D, band 1: failed, skoid=a1&skv=2  at '||url||' twice'||repeat('x', CAST(page_id%4*60 AS INT))"


@query(
    rf"""WITH m AS (SELECT page_id, {TOLD} AS t FROM pages), a AS (SELECT page_id, regexp_replace(t,'(?:/vsicurl/)?https?://(?:[^\s,''"()?/]*/)*([^\s,''"()?/]*)(?:\?[^\s,''"()]*)?','\1','g') AS t FROM m),
 b AS (SELECT page_id, regexp_replace(regexp_replace(t,'\S+, band (\d+): ','band \1: ','g'),'\?[^\s,''")]+','','g') AS t FROM a), c AS (SELECT page_id, regexp_replace(regexp_replace(t,'\b(?:sig|se|st|sp|sv|sr|skoid|sktid|skt|ske|sks|skv)=[^&\s,]*&?','','g'),'\S*%(?:3D|2F|2B)\S*','','g') AS t FROM b),
 d AS (SELECT page_id, trim(regexp_replace(t,'\s+',' ','g')) AS t FROM c) SELECT page_id, CASE WHEN length(t)>200 THEN left(t,199)||'…' ELSE t END AS message FROM d"""
)
def clean_messages(spark: SparkSession, sf: str) -> DataFrame:
    """messages without signed addresses and what is left of them."""
    head, tail = F.lit("GDAL on https://h.example/a/"), F.lit("/T44_B03.tif?sv=1&sig=q%3D said: zq%2Bx%3D, band 1: failed, skoid=a1&skv=2  at ")
    told = F.concat(head, "page_id", tail, "url", F.lit(" twice"), F.repeat(F.lit("x"), (F.col("page_id") % 4 * 60).cast("int")))
    return table(spark, sf, "pages").select("page_id", T.clean_message(told).alias("message"))


@query("SELECT page_id, regexp_replace(url,'^https?://(?:[^/]*/)*([^/?]*)(\\?.*)?$','\\1') AS file FROM pages")
def sanitise_url(spark: SparkSession, sf: str) -> DataFrame:
    """the file name that a page's address ends with."""
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"^https?://(?:[^/]*/)*([^/?]*)(\?.*)?$", "$1").alias("file"))


@query(
    """WITH t AS (SELECT l_orderkey AS id, replace(string_agg(CAST(CAST(l_quantity AS INT) AS VARCHAR), '|' ORDER BY l_linenumber), '|', CASE WHEN l_orderkey%3=0 THEN '; ' WHEN l_orderkey%3=1 THEN ', ' ELSE ' ' END)||CASE WHEN l_orderkey%10=0 THEN ' x' ELSE '' END AS t FROM lineitem GROUP BY l_orderkey),
 p AS (SELECT id, list_transform(string_split(trim(regexp_replace(t,'[,;\\s]+',' ','g')),' '), lambda x: TRY_CAST(x AS DOUBLE)) AS n FROM t)
 SELECT id, CAST(CASE WHEN len(list_filter(n, lambda x: x IS NULL))=0 THEN len(n) END AS INT) AS count, CASE WHEN len(list_filter(n, lambda x: x IS NULL))=0 THEN list_sum(n) END AS total FROM p"""
)
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """lists written with several separators; a list with anything else is null."""
    sep = F.element_at(F.array(F.lit("; "), F.lit(", "), F.lit(" ")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").cast("string").alias("v")))).alias("x"))
    text = F.concat(F.array_join("x.v", "|"), F.when(F.col("l_orderkey") % 10 == 0, " x").otherwise(""))
    n = li.select(F.col("l_orderkey").alias("id"), T.numbers(F.replace(text, F.lit("|"), sep)).alias("n"))
    return n.select("id", F.when(F.col("n").isNotNull(), F.size("n")).alias("count"), F.aggregate("n", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(
    """WITH y AS (SELECT o_orderpriority AS segment, CAST(year(o_orderdate) AS INT) AS year, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1,2)
 SELECT segment, year, concat_ws('; ', CASE WHEN year<1996 THEN 'warm-up' END, CASE WHEN dayofyear(a)>3 THEN 'from '||strftime(a,'%d %b %Y') END, CASE WHEN month(b)<12 OR day(b)<29 THEN 'to '||strftime(b,'%d %b %Y') END) AS notes FROM y"""
)
def part_notes(spark: SparkSession, sf: str) -> DataFrame:
    """A year's notes in order: warm-up, and the dates between which a part-year lies."""
    d = F.to_date("o_orderdate")
    y = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("segment"), F.year(d).alias("year")).agg(F.min(d).alias("a"), F.max(d).alias("b"))
    told = lambda word, c: F.concat(F.lit(word), F.date_format(c, "dd MMM yyyy"))
    late, short = F.dayofyear("a") > 3, (F.month("b") < 12) | (F.day("b") < 29)
    notes = F.concat_ws("; ", F.when(F.col("year") < 1996, "warm-up"), F.when(late, told("from ", "a")), F.when(short, told("to ", "b")))
    return y.select("segment", "year", notes.alias("notes"))


@query(
    """SELECT segment, measure, round(v,2) AS value FROM (SELECT c_mktsegment AS segment, avg(c_acctbal) AS mean, max(c_acctbal) AS most, min(c_acctbal) AS least FROM customer GROUP BY 1) UNPIVOT (v FOR measure IN (mean, most, least))"""
)
def unpivot_melt(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("most"), F.min("c_acctbal").alias("least"))
    return a.unpivot("segment", ["mean", "most", "least"], "measure", "value").select("segment", "measure", F.round("value", 2).alias("value"))


@query(
    """SELECT event_id AS id, CAST(json_extract(props,'$.k') AS BIGINT) AS k, event_type AS kind FROM events WHERE CAST(json_extract(props,'$.k') AS BIGINT) IS NOT NULL"""
)
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A map in JSON to rows."""
    k = F.from_json("props", "map<string,bigint>")["k"]
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), k.alias("k"), F.col("event_type").alias("kind")).where("k is not null")


@query(
    """WITH y AS (SELECT CAST(year(o_orderdate) AS INT) AS year, round(sum(CAST(round(o_totalprice*100) AS BIGINT))/1e6,4) AS v FROM orders GROUP BY 1)
 SELECT year, v FROM y WHERE year NOT BETWEEN 1997 AND 1998 UNION ALL SELECT year, v*2 FROM y WHERE year BETWEEN 1997 AND 1998"""
)
def replace_range(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a range of years give way to new ones."""
    y = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 1e6, 4).alias("v"))
    inside = F.col("year").between(1997, 1998)
    return y.where(~inside).unionByName(y.where(inside).withColumn("v", F.col("v") * 2))


@query(
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) WHERE k=1"""
)
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """Of repeated keys the first row stays, by an explicit order."""
    w = W.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf, "conversations").withColumn("k", F.row_number().over(w)).where("k = 1").select("conv_id", "turn", "role")


@query("SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey=r_regionkey WHERE lower(r_name) IN ('asia','region_2') OR lower(n_name) LIKE '%1'")
def lookup_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup by a name in any case."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    hit = F.lower("r_name").isin("asia", "region_2") | F.lower("n_name").like("%1")
    return n.where(hit).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
