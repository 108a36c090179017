"""Every operator of the linkage as a query over the given tables, with SQL that says the same.

The tables have no leads, so ``LEADS`` derives some from ``customer``, by arithmetic that
Spark and DuckDB do alike: three spellings of each person in turn, with tags, dots, case,
nicknames, extensions, legal forms and dates in several formats, some with a generation, a
title, an accent or a slip of the pen in the surname, and some rows that identify nobody. The SQL is written from the rules, not from the code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import Config
from kinfold.functions import normalize as N
from kinfold.functions import similarity as S
from kinfold.functions import vocabulary as V
from kinfold.operators import blocking, clustering, metrics, records, scoring, survivorship
from kinfold.operators.cut import cut
from kinfold.plans.clean import clean
from kinfold.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

FIRST = "robert,william,katherine,elizabeth,nora,ivo,samuel,patricia,dana,amos,helena,walter,james"
SHORT = "bob,bill,kate,liz,nora,ivo,sam,pat,dana,amos,helena,walter,jim"
LAST = "castellan,whitfield,brandt,marsh,roan,orwell,bergstrom,lindqvist,inge,obrien,mcdonald,smith-jones,quill,harrow,tindall,voss"
FIRM = "quarry lane,harbor tool & die,brandt optics,marshfield,fjord works,inge brothers,northgate,acme holdings,blue mill,the lantern"
FORM = "Inc.,LLC,GmbH,S.A.,Pty Ltd,Limited,& Co,"

#: Leads from ``customer``: one text for both engines.
LEADS = f"""
WITH k AS (
  SELECT c_custkey AS n, CAST(FLOOR(c_custkey / 3) AS BIGINT) AS p, c_custkey % 3 AS v, c_custkey % 23 AS odd, c_custkey % 7 AS w FROM {{customer}}
), parts AS (
  SELECT n, p, v, odd, w,
    split_part('{FIRST}', ',', CAST(p % 13 + 1 AS INT)) AS f, split_part('{SHORT}', ',', CAST(p % 13 + 1 AS INT)) AS s,
    split_part('{LAST}', ',', CAST(p % 16 + 1 AS INT)) AS l, split_part('{FIRM}', ',', CAST(p % 10 + 1 AS INT)) AS firm,
    split_part('{FORM}', ',', CAST(n % 8 + 1 AS INT)) AS form, lpad(CAST(p AS VARCHAR(20)), 4, '0') AS num
  FROM k
)
SELECT
  'r' || lpad(CAST(n AS VARCHAR(20)), 7, '0') AS id,
  CASE WHEN odd = 5 THEN 'N/A' WHEN odd = 17 THEN f || ' ' || l || ' Jr.' WHEN odd = 18 THEN f || ' ' || l || ', Sr.' WHEN odd = 19 THEN 'Dr. ' || f || ' ' || replace(l, 'a', 'á') || ', PhD'
    WHEN odd = 20 THEN f || ' ' || l || substr(l, length(l), 1) WHEN v = 0 THEN upper(f) || ' ' || l WHEN v = 1 THEN l || ', ' || s ELSE substr(f, 1, 1) || '. ' || l END AS full_name,
  CASE WHEN odd = 5 THEN 'unknown' WHEN odd = 7 THEN 'not an address' WHEN odd = 11 THEN 'Sales+eu@' || replace(l, '-', '') || '.example'
    WHEN p % 4 = 0 AND v = 1 THEN f || '.' || num || '+list@mailbox.example' WHEN p % 4 = 0 AND v = 2 THEN 'mailto:' || upper(f) || num || '@Mailbox.example'
    WHEN p % 4 = 0 THEN f || '.' || num || '@mailbox.example' WHEN p % 4 = 1 AND v <> 2 THEN f || num || '@' || replace(l, '-', '') || CAST(p % 3 AS VARCHAR(2)) || '.example' ELSE NULL END AS email,
  CASE WHEN odd = 5 THEN '-' WHEN odd = 9 THEN '12345' WHEN p % 4 = 2 AND v = 0 THEN '(555) 01' || substr(num, 1, 1) || '-' || num || ' x12'
    WHEN p % 4 = 2 AND v = 1 THEN '+1 555.01' || substr(num, 1, 1) || '.' || num WHEN p % 4 = 2 THEN '15550' || '1' || substr(num, 1, 1) || num
    WHEN p % 4 = 3 AND v = 0 THEN '0044 20 7946 ' || num WHEN p % 4 = 3 THEN '+358 40 123' || num ELSE NULL END AS phone,
  CASE WHEN odd = 3 THEN 'tbd' WHEN w = 0 THEN upper(firm) || ', ' || form WHEN w = 1 THEN firm ELSE firm || ' ' || form END AS company,
  CASE WHEN odd = 13 THEN 'https://www.' || replace(l, '-', '') || '.example:8080/about?x=1' WHEN odd = 14 THEN 'gmail.com'
    WHEN p % 4 = 1 AND v = 2 THEN 'www.' || replace(l, '-', '') || CAST(p % 3 AS VARCHAR(2)) || '.example' ELSE NULL END AS website,
  CASE WHEN w = 2 THEN 'HEAD OF  SALES AND CRM' WHEN w = 3 THEN 'Analyst' WHEN w = 4 THEN 'none' ELSE NULL END AS title,
  CASE WHEN w = 0 THEN 'CRM Export' WHEN w = 1 THEN 'enrichment' WHEN w = 2 THEN 'event_list' WHEN w = 3 THEN 'somewhere' WHEN w = 4 THEN NULL ELSE 'purchased-list' END AS source,
  CASE WHEN w = 0 THEN '2025-0' || CAST(v + 1 AS VARCHAR(2)) || '-1' || CAST(v AS VARCHAR(2)) WHEN w = 1 THEN CAST(v + 13 AS VARCHAR(2)) || '/02/2025' WHEN w = 2 THEN '03/04/2025'
    WHEN w = 3 THEN 'Feb ' || CAST(v + 1 AS VARCHAR(2)) || ', 2026' WHEN w = 4 THEN CAST(v + 1 AS VARCHAR(2)) || ' March 2024' WHEN w = 5 THEN '2025-13-01' ELSE NULL END AS updated_at,
  'p' || CAST(p AS VARCHAR(20)) AS true_person_id
FROM parts
"""


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEADS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.triaged(records.normalized(leads(spark, sf_dir), Config()))


def _matchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_records(spark, sf_dir)).filter("held_reason IS NULL")


# --- scalars ------------------------------------------------------------------------------


def email_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.EMAIL.on(leads(spark, sf_dir), "mail", raw=F.col("email"))
    return found.select("id", "mail.normalized", "mail.canonical", "mail.local_part", "mail.domain", "mail.kind")


def phone_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.phone_of("US").on(leads(spark, sf_dir), "line", raw=F.col("phone"))
    return found.select("id", "line.e164", "line.extension", "line.valid", N.last_seven(F.col("line.e164")).alias("last_seven"))


def company_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = leads(spark, sf_dir).select("id", N.given(F.col("company")).alias("g"))
    found = N.COMPANY.on(given.withColumn("p", N.fold(F.col("g"))), "firm", given=F.col("g"), plain=F.col("p"))
    return found.select("id", F.col("firm.normalized").alias("company"), F.col("firm.key").alias("company_key"))


def host_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", N.host(F.col("url")).alias("host"))


def domain_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.EMAIL.on(leads(spark, sf_dir), "mail", raw=F.col("email"))
    return found.select("id", N.domain(F.col("website"), F.col("mail")).alias("d")).select("id", "d.value", "d.origin")


def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.DATE.on(leads(spark, sf_dir), "day", raw=F.col("updated_at")).select("id", "day")


def title_source_tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.TITLE.on(leads(spark, sf_dir), "t", raw=F.col("title"))
    return found.select("id", F.col("t.tidied").alias("title"), N.source(F.col("source")).alias("source"))


def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir)
    return rows.select("id", *(N.is_placeholder(F.col(c)).alias(f"no_{c}") for c in ("full_name", "email", "phone", "company", "title")))


def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leads(spark, sf_dir).select("id", N.name(F.col("full_name"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("n"))
    return rows.select("id", "n.first", "n.last", "n.first_canonical", "n.display")


def soundex_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", "last_key")


def change_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.notes(_records(spark, sf_dir))


def part_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaro, Jaro-Winkler and token sets of neighbouring part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    both = part.join(other, "p_partkey")
    names = F.col("p_name"), F.col("next_name")
    return both.select("p_partkey", S.jaro_column(*names).alias("jaro"), S.jaro_winkler_column(*names).alias("jaro_winkler"), S.token_set_column(*names).alias("token_set"))


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of neighbouring part names stand for one another."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next_name"))
    found = part.join(other, "p_partkey").select("p_partkey", S.token_set_details(F.col("p_name"), F.col("next_name")).alias("t"))
    return found.select("p_partkey", "t.score", "t.containment", F.array_join(F.transform("t.pairs", lambda p: F.concat_ws("=", p["a"], p["b"])), ",").alias("pairs"))


# --- relational steps ---------------------------------------------------------------------


def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", F.col("held_reason").isNotNull().alias("held"))


def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all seven kinds."""
    return blocking.keyed(_matchable(spark, sf_dir))


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cut(block_keys(spark, sf_dir))
    return blocking.blocked_pairs(keys, blocking.block_sizes(keys), Config().max_block_size)


def skipped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of more than 8 rows."""
    return blocking.skipped(blocking.block_sizes(block_keys(spark, sf_dir)), 8)


def exhaustive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("id"))
    return blocking.all_pairs(rows, Config().exhaustive_limit)


def mailbox_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matchable(spark, sf_dir)
    keys = blocking.keyed(found).filter(F.col("key").startswith("email:"))
    pairs = blocking.blocked_pairs(keys, blocking.block_sizes(keys), Config().max_block_size)
    return scoring.with_records(pairs, scoring.sides(found)).filter(scoring.same_mailbox()).select("a", "b")


def rule_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused candidates, by the first rule that refuses them."""
    found = _matchable(spark, sf_dir)
    keys = cut(blocking.keyed(found))
    pairs = blocking.blocked_pairs(keys, blocking.block_sizes(keys), Config().max_block_size)
    refused = scoring.with_records(pairs, scoring.sides(found)).select("a", "b", scoring.refusing_rule().alias("rule"))
    return refused.filter("rule IS NOT NULL")


def scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = clean(leads(spark, sf_dir))
    return run.edges.select("a", "b", "kind", "score", "route")


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of leads that share a mailbox, each with its size."""
    found = clustering.components(mailbox_edges(spark, sf_dir))
    return found.groupBy("component").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def constrained_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters when, of three spellings of a person, the first and last are marked as different."""
    rows = leads(spark, sf_dir)
    marked = rows.groupBy("true_person_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b AND conv(substr(true_person_id, 2), 10, 10) % 8 = 0")
    decisions = marked.select(F.lit("must-not-link").alias("kind"), "a", "b")
    return clean(rows, constraints=decisions).membership


def survivorship_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving property of each user's events: type as source, time as date, id as last resort."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    offered = events.select(
        F.col("user_id").cast("string").alias("cluster"), F.lit("value").alias("field"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.floor("value").cast("long").cast("string").alias("value"), (F.col("value") >= 10).alias("valid"), F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("updated_at"),
    )
    won = survivorship.winners(offered.filter("value IS NOT NULL"), ("purchase", "click", "view"))
    lost = F.array_join(F.transform("conflicts", lambda c: F.concat_ws("=", c["id"], c["value"])), ",")
    return won.select(F.col("cluster").alias("user_id"), "winner_id", "value", "rule", F.size("conflicts").cast("long").alias("n_conflicts"), lost.alias("conflicts"))


def true_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = metrics.true_pairs(leads(spark, sf_dir))
    return truth.agg(F.count("*").alias("true_pairs"), F.min("a").alias("first_a"), F.max("b").alias("last_b"))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of shared mailboxes, taken as predictions."""
    predicted, truth = mailbox_edges(spark, sf_dir).withColumn("p", F.lit(1)), metrics.true_pairs(leads(spark, sf_dir)).withColumn("t", F.lit(1))
    both = predicted.join(truth, ["a", "b"], "full").agg(F.count("p").alias("p"), F.count("t").alias("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("h"))
    return both.select(metrics.ratio(F.col("h"), F.col("p"), 1.0).alias("precision"), metrics.ratio(F.col("h"), F.col("t"), 1.0).alias("recall"))


def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason of every pair that is open for review."""
    return clean(leads(spark, sf_dir)).review.select("a", "b", F.posexplode("reasons").alias("place", "r")).select("a", "b", "place", "r.rule", "r.verdict", "r.weight")


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a run, with precision and recall against the true persons."""
    m = clean(leads(spark, sf_dir)).metrics
    row = (m["rowsIn"], m["quarantined"], m["clusters"], m["autoMerged"], m["pendingReview"], m["refused"], m["comparisons"], m["dedupRate"], m["comparisonRatio"], m["groundTruth"]["autoPrecision"], m["groundTruth"]["autoRecall"])
    names = "rows_in long, quarantined long, clusters long, auto_merged long, pending long, refused long, comparisons long, dedup_rate double, comparison_ratio double, auto_precision double, auto_recall double"
    return spark.createDataFrame([row], names)


def clean_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person with more than one row: its rows and how it came about."""
    return clean(leads(spark, sf_dir)).merged.select("id", F.array_join("member_ids", " ").alias("member_ids"), "row_count", "strength", F.size("edges").cast("long").alias("n_edges"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = clean(leads(spark, sf_dir))
    open_ = run.edges.filter("kind = 'probable'")
    steps = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]
    return metrics.threshold_sweep(open_, metrics.pairs_within(run.membership, "cluster", "id"), metrics.true_pairs(run.rows), steps)


def clean_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run, as the file of people and rows held back."""
    return sinks.cleaned(clean(leads(spark, sf_dir)))


def clean_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.review(clean(leads(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        email_normalize, phone_normalize, company_normalize, host_from, domain_pick, timestamp_parse, title_source_tidy,
        placeholder_filter, name_split, soundex_keys, change_notes, part_similarity, token_pairs, quarantine_split, block_keys, block_pairs,
        skipped_blocks, exhaustive_pairs, mailbox_edges, rule_refusals, scored_edges, connected_components, constrained_clusters,
        survivorship_events, true_pair_counts, precision_recall, threshold_sweep, review_reasons, run_counts, clean_clusters, clean_people, clean_review,
    )
}


# --- the same in SQL ----------------------------------------------------------------------


def _list(values: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _stand_in(column: str) -> str:
    bare = f"lower(trim(coalesce({column}, '')))"
    squeezed = f"regexp_replace({bare}, '[^a-z0-9]', '', 'g')"
    return f"({bare} = '' OR {bare} IN {_list(V.PLACEHOLDERS)} OR (length({bare}) <= 20 AND {squeezed} <> '' AND {squeezed} IN {_list(V.PLACEHOLDERS)}))"


_L = "leads AS (" + LEADS.replace("{customer}", "customer").strip() + ")"
_FORMS = "|".join(sorted(V.LEGAL_FORMS, key=len, reverse=True))
_HOST = r"([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}"

_MAIL = rf"""
m0 AS (SELECT *, {_stand_in("email")} AS gone, lower(regexp_replace(trim(coalesce(email, '')), '^mailto:', '')) AS normal FROM leads),
m1 AS (SELECT *, regexp_matches(normal, '^[^\s@,;:<>()"]+@{_HOST}$') AS shaped, split_part(normal, '@', 1) AS local, split_part(normal, '@', 2) AS dom FROM m0),
m2 AS (SELECT *, split_part(local, '+', 1) AS tagless FROM m1),
m3 AS (SELECT *, CASE WHEN dom IN {_list(V.DOTLESS)} THEN replace(tagless, '.', '') ELSE tagless END AS box FROM m2),
mail AS (SELECT *, CASE WHEN gone THEN 'missing' WHEN NOT shaped OR box = '' THEN 'invalid' WHEN regexp_replace(tagless, '[._-]', '', 'g') IN {_list(V.ROLES)} THEN 'role'
  WHEN dom IN {_list(V.FREEMAIL)} THEN 'freemail' ELSE 'personal' END AS mkind FROM m3)"""
_CANON = "CASE WHEN NOT gone AND shaped AND box <> '' THEN box || '@' || dom END"

_LINE = f"""
p0 AS (SELECT *, {_stand_in("phone")} AS nophone, regexp_extract(coalesce(phone, ''), 'x([0-9]{{1,6}})$', 1) AS ext FROM <from>),
p1 AS (SELECT *, trim(CASE WHEN ext <> '' THEN regexp_replace(phone, 'x[0-9]+$', '') ELSE coalesce(phone, '') END) AS body FROM p0),
p2 AS (SELECT *, regexp_replace(body, '[^0-9]', '', 'g') AS dig FROM p1),
p3 AS (SELECT *, CASE WHEN body LIKE '+%' THEN dig WHEN body LIKE '00%' THEN substr(dig, 3) END AS abroad FROM p2),
line AS (SELECT *,
  CASE WHEN nophone OR dig = '' THEN NULL WHEN abroad IS NOT NULL THEN '+' || abroad WHEN dig LIKE '1%' AND length(dig) = 11 THEN '+' || dig WHEN length(dig) = 10 THEN '+1' || dig END AS e164,
  CASE WHEN nophone OR dig = '' THEN FALSE WHEN abroad LIKE '358%' THEN length(abroad) BETWEEN 8 AND 15 WHEN abroad LIKE '44%' THEN length(abroad) - 2 IN (10, 9)
    WHEN abroad LIKE '1%' THEN length(abroad) = 11 ELSE (dig LIKE '1%' AND length(dig) = 11) OR length(dig) = 10 END AS lvalid FROM p3)"""
_SEVEN = "CASE WHEN length(regexp_replace(e164, '[^0-9]', '', 'g')) >= 7 THEN right(regexp_replace(e164, '[^0-9]', '', 'g'), 7) END"

_FIRM = rf"""
f0 AS (SELECT *, {_stand_in("company")} AS nofirm, regexp_replace(coalesce(company, ''), 'S\.A\.', 'SA') AS joined FROM <from>),
f1 AS (SELECT *, lower(trim(regexp_replace(replace(joined, '&', ' and '), '[^A-Za-z0-9]+', ' ', 'g'))) AS words FROM f0),
f2 AS (SELECT *, CASE WHEN words LIKE 'the %' THEN substr(words, 5) ELSE words END AS named FROM f1),
firm AS (SELECT *, CASE WHEN NOT nofirm AND words <> '' THEN regexp_replace(named, '( ({_FORMS}))+$', '') END AS fkey FROM f2)"""

#: Names of the leads have one surname token; the given name is whole, short or an initial.
_NAMED = f"""
n0 AS (SELECT *, {_stand_in("full_name")} AS noname, strip_accents(lower(regexp_replace(regexp_replace(regexp_replace(full_name, ',? (Jr|Sr)[.]$', ''), ', PhD$', ''), '^Dr[.] ', ''))) AS bare FROM <from>),
n1 AS (SELECT *, CASE WHEN noname THEN NULL WHEN bare LIKE '%,%' THEN trim(split_part(bare, ',', 1)) ELSE split_part(bare, ' ', 2) END AS nlast,
  CASE WHEN noname THEN NULL WHEN bare LIKE '%,%' THEN trim(split_part(bare, ',', 2)) ELSE rtrim(split_part(bare, ' ', 1), '.') END AS nfirst,
  CASE WHEN full_name LIKE '% Jr.' THEN 'jr' WHEN full_name LIKE '% Sr.' THEN 'sr' END AS ngen FROM n0)"""


def _soundex(word: str) -> str:
    """American Soundex in SQL: h and w are passed over, vowels part equal codes, the first letter stands for its own."""
    letters = f"regexp_replace(upper({word}), '[^A-Z]', '', 'g')"
    digits = f"translate(substr({letters}, 1, 1) || regexp_replace(substr({letters}, 2), '[HW]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    merged = digits
    for d in "123456":
        merged = f"regexp_replace({merged}, '{d}+', '{d}', 'g')"
    return f"(CASE WHEN {letters} <> '' THEN substr({letters}, 1, 1) || substr(replace(substr({merged}, 2), '0', '') || '000', 1, 3) ELSE '' END)"


def _formal() -> str:
    """CASE for the one formal name of each name in the table; null where there are several."""
    table = N.formal_names(V.NICKNAMES)
    return "CASE " + " ".join(f"WHEN nfirst = '{k}' THEN {repr(v[0]) if len(v) == 1 else 'NULL'}" for k, v in table.items()) + " ELSE nfirst END"


_SITE = r"regexp_replace(split_part(split_part(regexp_replace(website, '^https://', ''), '/', 1), ':', 1), '^www\.', '')"
_ALL = f"{_L}, {_MAIL}, {_LINE.replace('<from>', 'mail')}, {_FIRM.replace('<from>', 'line')}, {_NAMED.replace('<from>', 'firm')}, named AS (SELECT *, {_formal()} AS ncanon, CASE WHEN nlast IS NOT NULL THEN {_soundex('nlast')} END AS nkey, CASE WHEN {_SITE} IS NOT NULL AND {_SITE} NOT IN {_list(V.FREEMAIL)} THEN {_SITE} WHEN mkind = 'personal' THEN dom END AS site FROM n1)"
_PERSON = "mkind IN ('personal', 'freemail')"
_MATCH = f"({_PERSON} OR lvalid OR (nlast IS NOT NULL AND fkey IS NOT NULL))"
_KEYS = f"""{_ALL}, keys AS (
  SELECT id, 'email:' || {_CANON} AS key FROM named WHERE {_MATCH} AND {_PERSON}
  UNION SELECT id, 'local:' || box FROM named WHERE {_MATCH} AND {_PERSON}
  UNION SELECT id, 'phone7:' || {_SEVEN} FROM named WHERE {_MATCH} AND {_SEVEN} IS NOT NULL
  UNION SELECT id, 'sound-company:' || nkey || '|' || fkey FROM named WHERE {_MATCH} AND nkey IS NOT NULL AND fkey IS NOT NULL
  UNION SELECT id, 'domain-name:' || site || '|' || coalesce(substr(nfirst, 1, 1), '?') || nkey FROM named WHERE {_MATCH} AND nkey IS NOT NULL AND site IS NOT NULL
  UNION SELECT id, 'company-initial:' || fkey || '|' || substr(nfirst, 1, 1) FROM named WHERE {_MATCH} AND fkey IS NOT NULL AND nfirst IS NOT NULL
  UNION SELECT id, 'name:' || coalesce(ncanon, nfirst, '?') || '|' || nlast FROM named WHERE {_MATCH} AND nlast IS NOT NULL),
sizes AS (SELECT key, count(*) AS size FROM keys GROUP BY key HAVING count(*) > 1)"""
_BOXES = f"{_KEYS}, edges AS (SELECT DISTINCT l.id AS a, r.id AS b FROM keys l JOIN keys r ON l.key = r.key AND l.id < r.id JOIN sizes s ON s.key = l.key WHERE l.key LIKE 'email:%' AND s.size <= 200)"

_TITLE = "trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "email_normalize": f"WITH {_L}, {_MAIL} SELECT id, CASE WHEN NOT gone THEN normal END AS normalized, {_CANON} AS canonical, CASE WHEN NOT gone AND shaped THEN local END AS local_part, CASE WHEN NOT gone AND shaped THEN dom END AS domain, mkind AS kind FROM mail",
    "phone_normalize": f"WITH {_L}, {_LINE.replace('<from>', 'leads')} SELECT id, e164, CASE WHEN NOT nophone AND ext <> '' THEN ext END AS extension, lvalid AS valid, {_SEVEN} AS last_seven FROM line",
    "company_normalize": f"WITH {_L}, {_FIRM.replace('<from>', 'leads')} SELECT id, CASE WHEN fkey IS NOT NULL THEN array_to_string(list_transform(string_split(fkey, ' '), lambda t: upper(substr(t, 1, 1)) || substr(t, 2)), ' ') END AS company, fkey AS company_key FROM firm",
    "host_from": rf"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(split_part(split_part(split_part(regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^.*@', ''), '/', 1), '?', 1), '#', 1), ':[0-9]+$', ''), '\.+$', ''), '^www\.', '') AS host FROM pages)
      SELECT page_id, CASE WHEN regexp_matches(host, '^{_HOST}$') THEN host END AS host FROM h""",
    "domain_pick": rf"""WITH {_L}, {_MAIL}, d AS (SELECT *, regexp_replace(split_part(split_part(regexp_replace(website, '^https://', ''), '/', 1), ':', 1), '^www\.', '') AS site FROM mail)
      SELECT id, CASE WHEN site IS NOT NULL AND site NOT IN {_list(V.FREEMAIL)} THEN site WHEN mkind = 'personal' THEN dom END AS value,
      CASE WHEN site IS NOT NULL AND site NOT IN {_list(V.FREEMAIL)} THEN 'website' WHEN mkind = 'personal' THEN 'email' ELSE 'none' END AS origin FROM d""",
    "timestamp_parse": rf"""WITH {_L} SELECT id, CASE
      WHEN regexp_matches(updated_at, '^2025-0') THEN updated_at
      WHEN regexp_matches(updated_at, '^1[3-9]/') THEN split_part(updated_at, '/', 3) || '-' || split_part(updated_at, '/', 2) || '-' || split_part(updated_at, '/', 1)
      WHEN updated_at LIKE 'Feb %' THEN '2026-02-0' || substr(updated_at, 5, 1) WHEN updated_at LIKE '% March 2024' THEN '2024-03-0' || substr(updated_at, 1, 1) END AS day FROM leads""",
    "title_source_tidy": f"""WITH {_L} SELECT id, CASE WHEN {_stand_in("title")} THEN NULL WHEN {_TITLE} = 'HEAD OF SALES AND CRM' THEN 'Head of Sales and CRM' ELSE {_TITLE} END AS title,
      CASE WHEN {_stand_in("source")} THEN NULL ELSE regexp_replace(lower(trim(source)), '[\\s_]+', '-', 'g') END AS source FROM leads""",
    "placeholder_filter": f"WITH {_L} SELECT id, " + ", ".join(f"{_stand_in(c)} AS no_{c}" for c in ("full_name", "email", "phone", "company", "title")) + " FROM leads",
    "quarantine_split": f"WITH {_ALL} SELECT id, NOT {_MATCH} AS held FROM named",
    "block_keys": f"WITH {_KEYS} SELECT id, key FROM keys",
    "block_pairs": f"WITH {_KEYS} SELECT DISTINCT l.id AS a, r.id AS b FROM keys l JOIN keys r ON l.key = r.key AND l.id < r.id JOIN sizes s ON s.key = l.key WHERE s.size <= 200",
    "skipped_blocks": f"WITH {_KEYS} SELECT key, size FROM sizes WHERE size > 8",
    "exhaustive_pairs": "SELECT l.n_name AS a, r.n_name AS b FROM nation l JOIN nation r ON l.n_name < r.n_name",
    "mailbox_edges": f"WITH {_BOXES} SELECT a, b FROM edges",
    "rule_refusals": f"""WITH {_KEYS}, full_ AS (SELECT id, {_CANON} AS canon, dom, mkind FROM named)
      SELECT DISTINCT l.id AS a, r.id AS b, 'corporate mailboxes at two employers' AS rule FROM keys l JOIN keys r ON l.key = r.key AND l.id < r.id JOIN sizes s ON s.key = l.key
      JOIN full_ x ON x.id = l.id JOIN full_ y ON y.id = r.id
      WHERE l.key LIKE 'name:%' AND s.size <= 200 AND x.mkind = 'personal' AND y.mkind = 'personal' AND x.canon <> y.canon AND x.dom <> y.dom""",
    "connected_components": f"""WITH RECURSIVE {_BOXES}, both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges UNION SELECT a, a FROM edges UNION SELECT b, b FROM edges),
      reach AS (SELECT a AS id, b AS other FROM both_ UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON r.other = e.a),
      labels AS (SELECT id, min(other) AS component FROM reach GROUP BY id) SELECT component, count(*) AS n, max(id) AS last_id FROM labels GROUP BY component""",
    "survivorship_events": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value, value >= 10 AS ok,
      CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE CASE WHEN event_type IS NULL THEN 4 ELSE 3 END END AS trust, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events WHERE value IS NOT NULL),
      o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, trust, day DESC, id) AS place FROM e),
      w AS (SELECT * FROM o WHERE place = 1), others AS (SELECT o.user_id, o.value, min(o.id) AS id FROM o JOIN w ON w.user_id = o.user_id AND w.value <> o.value GROUP BY o.user_id, o.value),
      lost AS (SELECT user_id, count(*) AS n, string_agg(id || '=' || value, ',' ORDER BY id) AS lost FROM others GROUP BY user_id),
      a AS (SELECT user_id, count(*) AS n, bool_or(NOT ok) AS some_bad, max(trust) AS worst, min(day) AS earliest FROM o GROUP BY user_id)
      SELECT w.user_id, w.id AS winner_id, w.value, CASE WHEN a.n = 1 THEN 'the only value' WHEN some_bad AND w.ok THEN 'the others could not be read as this field' WHEN worst > w.trust THEN 'the most trusted source, ' || coalesce(event_type, 'unnamed')
        WHEN earliest < w.day THEN 'the latest of equally trusted rows, ' || w.day ELSE 'the smallest row id' END AS rule, coalesce(lost.n, 0) AS n_conflicts, coalesce(lost, '') AS conflicts
      FROM w JOIN a ON a.user_id = w.user_id LEFT JOIN lost ON lost.user_id = w.user_id""",
    "true_pair_counts": f"WITH {_L} SELECT count(*) AS true_pairs, min(l.id) AS first_a, max(r.id) AS last_b FROM leads l JOIN leads r ON l.true_person_id = r.true_person_id AND l.id < r.id",
    "precision_recall": f"""WITH {_BOXES}, truth AS (SELECT l.id AS a, r.id AS b FROM leads l JOIN leads r ON l.true_person_id = r.true_person_id AND l.id < r.id),
      n AS (SELECT (SELECT count(*) FROM edges) AS p, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM edges e JOIN truth t ON e.a = t.a AND e.b = t.b) AS h)
      SELECT CASE WHEN p = 0 THEN 1.0 ELSE CAST(h AS DOUBLE) / p END AS precision, CASE WHEN t = 0 THEN 1.0 ELSE CAST(h AS DOUBLE) / t END AS recall FROM n""",
}
_CAPITAL = "array_to_string(list_transform(string_split({0}, '-'), lambda t: CASE WHEN t LIKE 'mc__%' THEN 'Mc' || upper(substr(t, 3, 1)) || substr(t, 4) ELSE upper(substr(t, 1, 1)) || substr(t, 2) END), '-')"
ORACLE_SQL["name_split"] = f"""WITH {_L}, {_NAMED.replace('<from>', 'leads')}, nn AS (SELECT *, {_formal()} AS ncanon FROM n1)
  SELECT id, nfirst AS first, nlast AS last, ncanon AS first_canonical,
  CASE WHEN nfirst IS NOT NULL THEN {_CAPITAL.format('nfirst')} || ' ' || {_CAPITAL.format('nlast')} || CASE ngen WHEN 'jr' THEN ' Jr.' WHEN 'sr' THEN ' Sr.' ELSE '' END END AS display FROM nn"""
ORACLE_SQL["soundex_keys"] = f"WITH {_ALL} SELECT id, nkey AS last_key FROM named"


# --- similarity in SQL: one step of a recursion for each letter or token --------------------


def _d(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _jaro_sql(name: str, pairs: str) -> str:
    """CTEs up to ``name`` (a, b, jaro, jw) for the distinct pairs (a, b) that ``pairs`` selects."""
    starts = " ".join(f"WHEN substr(a, 1, {k}) = substr(b, 1, {k}) AND length(a) >= {k} AND length(b) >= {k} THEN {k}" for k in (4, 3, 2, 1))
    return f"""{name}_of AS ({pairs}),
    {name}_walk AS (
      SELECT a, b, 0 AS i, CAST([] AS BIGINT[]) AS used, '' AS met, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM {name}_of
      UNION ALL
      SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN met ELSE met || substr(a, i + 1, 1) END, reach FROM (
        SELECT *, list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda k: NOT list_contains(used, k) AND substr(b, k, 1) = substr(a, i + 1, 1))[1] AS j FROM {name}_walk WHERE i < length(a))),
    {name}_done AS (SELECT a, b, len(used) AS m, met, array_to_string(list_transform(list_sort(used), lambda k: substr(b, k, 1)), '') AS other FROM {name}_walk WHERE i = length(a)),
    {name}_base AS (SELECT a, b, CASE WHEN a = b THEN {_d(1.0)} WHEN m = 0 THEN {_d(0.0)}
      ELSE (CAST(m AS DOUBLE) / length(a) + CAST(m AS DOUBLE) / length(b) + (m - len(list_filter(range(1, m + 1), lambda k: substr(met, k, 1) <> substr(other, k, 1))) / {_d(2.0)}) / m) / 3 END AS jaro FROM {name}_done),
    {name} AS (SELECT a, b, jaro, CASE WHEN jaro < {_d(0.7)} THEN jaro ELSE jaro + (CASE {starts} ELSE 0 END) * {_d(0.1)} * (1 - jaro) END AS jw FROM {name}_base)"""


def _tokens_sql(name: str, pairs: str) -> str:
    """CTEs up to ``name`` (a, b, score, containment, pairs): token sets of the distinct pairs (a, b)."""
    tokens = "list_sort(list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')))"
    return f"""{name}_of AS ({pairs}), {name}_lists AS (SELECT a, b, {tokens.format('a')} AS l, {tokens.format('b')} AS r FROM {name}_of),
    {_jaro_sql(name + '_jw', f"SELECT DISTINCT a, b FROM (SELECT a, unnest(r) AS b FROM (SELECT unnest(l) AS a, r FROM {name}_lists))")},
    {name}_near AS (SELECT p.a, p.b, list(struct_pack(l := j.a, n := -j.jw, r := j.b) ORDER BY j.a, -j.jw, j.b) AS near
      FROM (SELECT a, b, unnest(l) AS x, r FROM {name}_lists) p, {name}_jw j WHERE j.a = p.x AND list_contains(p.r, j.b) AND j.jw >= {_d(0.9)} GROUP BY p.a, p.b),
    {name}_walk AS (
      SELECT t.a, t.b, l, r, near, 1 AS i, CAST([] AS VARCHAR[]) AS used, {_d(0.0)} AS weight, CAST([] AS VARCHAR[]) AS pairs FROM {name}_lists t LEFT JOIN {name}_near n ON t.a = n.a AND t.b = n.b
      UNION ALL
      SELECT a, b, l, r, near, i + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.r) END, CASE WHEN best IS NULL THEN weight ELSE weight - best.n END, CASE WHEN best IS NULL THEN pairs ELSE list_append(pairs, best.l || '=' || best.r) END FROM (
        SELECT *, list_filter(near, lambda c: c.l = l[i] AND NOT list_contains(used, c.r))[1] AS best FROM {name}_walk WHERE i <= len(l))),
    {name} AS (SELECT a, b, CASE WHEN len(l) = 0 OR len(r) = 0 THEN {_d(0.0)} ELSE weight / greatest(len(l), len(r)) END AS score,
      CASE WHEN len(l) = 0 OR len(r) = 0 THEN {_d(0.0)} ELSE weight / least(len(l), len(r)) END AS containment, array_to_string(pairs, ',') AS pairs FROM {name}_walk WHERE i = len(l) + 1)"""


_NEIGHBOURS = "neighbours AS (SELECT p.p_partkey, p.p_name AS a, q.p_name AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)"
ORACLE_SQL["part_similarity"] = f"""WITH RECURSIVE {_NEIGHBOURS}, {_jaro_sql('s', 'SELECT DISTINCT a, b FROM neighbours')}, {_tokens_sql('t', 'SELECT DISTINCT a, b FROM neighbours')}
  SELECT p_partkey, jaro, jw AS jaro_winkler, score AS token_set FROM neighbours n JOIN s ON s.a = n.a AND s.b = n.b JOIN t ON t.a = n.a AND t.b = n.b"""
ORACLE_SQL["token_pairs"] = f"WITH RECURSIVE {_NEIGHBOURS}, {_tokens_sql('t', 'SELECT DISTINCT a, b FROM neighbours')} SELECT p_partkey, score, containment, pairs FROM neighbours n JOIN t ON t.a = n.a AND t.b = n.b"


# --- scores, routes and clusters in SQL ------------------------------------------------------


def _groups_sql() -> str:
    """CASE for the formal names that a given name can stand for."""
    whens = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in N.formal_names(V.NICKNAMES).items())
    return f"CASE nfirst {whens} ELSE [nfirst] END"


_KNOWN = _list(tuple(N.formal_names(V.NICKNAMES)))
_SCORED = f"""{_KEYS}, side AS (SELECT id, nfirst, nlast, ngen, nfirst IN {_KNOWN} AS known, {_groups_sql()} AS groups, {_CANON} AS canon, dom, mkind, {_PERSON} AS person, e164, CASE WHEN NOT nophone AND ext <> '' THEN ext END AS extension,
    lvalid, {_SEVEN} AS seven, fkey, site FROM named),
  met AS (SELECT DISTINCT l.id AS a, r.id AS b FROM keys l JOIN keys r ON l.key = r.key AND l.id < r.id JOIN sizes s ON s.key = l.key WHERE s.size <= 200),
  both_sides AS (SELECT m.a, m.b, x, y FROM met m JOIN side x ON x.id = m.a JOIN side y ON y.id = m.b),
  ruled AS (SELECT *, CASE WHEN x.mkind = 'personal' AND y.mkind = 'personal' AND x.canon <> y.canon AND x.dom <> y.dom THEN 'corporate mailboxes at two employers' WHEN x.ngen <> y.ngen THEN 'generations differ' END AS rule FROM both_sides),
  {_jaro_sql('names', "SELECT DISTINCT x.nlast AS a, y.nlast AS b FROM ruled WHERE x.nlast IS NOT NULL AND y.nlast IS NOT NULL UNION SELECT DISTINCT x.nfirst, y.nfirst FROM ruled WHERE x.nfirst IS NOT NULL AND y.nfirst IS NOT NULL")},
  named_pairs AS (SELECT p.*, coalesce(s.jw, {_d(0.5)}) AS surname,
    CASE WHEN x.nfirst IS NULL OR y.nfirst IS NULL THEN {_d(0.0)}
      WHEN length(x.nfirst) = 1 AND length(y.nfirst) = 1 THEN CASE WHEN x.nfirst = y.nfirst THEN {_d(0.6)} ELSE {_d(0.0)} END
      WHEN length(x.nfirst) = 1 OR length(y.nfirst) = 1 THEN CASE WHEN x.nfirst[1] = y.nfirst[1] THEN {_d(0.85)} ELSE {_d(0.0)} END
      WHEN x.nfirst = y.nfirst THEN {_d(1.0)} WHEN list_has_any(x.groups, y.groups) THEN {_d(0.95)} WHEN x.known AND y.known THEN {_d(0.4)} ELSE g.jw END AS given
    FROM ruled p LEFT JOIN names s ON s.a = x.nlast AND s.b = y.nlast LEFT JOIN names g ON g.a = x.nfirst AND g.b = y.nfirst),
  {_tokens_sql('firms', "SELECT DISTINCT x.fkey AS a, y.fkey AS b FROM ruled WHERE x.fkey IS NOT NULL AND y.fkey IS NOT NULL")},
  weighed AS (SELECT p.*, {_d(0.6)} * surname + {_d(0.4)} * given AS name_score, f.score AS company_score, coalesce(x.site = y.site, FALSE) AS same_domain, coalesce(x.seven = y.seven, FALSE) AS same_seven,
    x.person AND y.person AND coalesce(x.canon = y.canon, FALSE) AS by_mailbox,
    x.lvalid AND y.lvalid AND coalesce(x.e164 = y.e164, FALSE) AND NOT coalesce(x.extension <> y.extension, FALSE) AND surname >= {_d(0.92)} AND given >= {_d(0.85)} AND (coalesce(x.fkey = y.fkey, FALSE) OR coalesce(x.site = y.site, FALSE)) AS by_line
    FROM named_pairs p LEFT JOIN firms f ON f.a = x.fkey AND f.b = y.fkey),
  summed AS (SELECT *, {_d(0.45)} * name_score + coalesce({_d(0.3)} * company_score, {_d(0.0)}) + CASE WHEN same_domain THEN {_d(0.15)} ELSE {_d(0.0)} END AS total, NOT same_seven AND x.lvalid AND y.lvalid AS two_phones FROM weighed),
  scored AS (SELECT *, CASE WHEN rule IS NOT NULL THEN 'refused' WHEN by_mailbox OR by_line THEN 'authoritative' ELSE 'probable' END AS kind,
    CASE WHEN rule IS NOT NULL THEN {_d(0.0)} WHEN by_mailbox OR by_line THEN {_d(1.0)} WHEN name_score < {_d(0.8)} THEN {_d(0.0)}
      ELSE greatest({_d(0.0)}, least({_d(1.0)}, CASE WHEN same_seven THEN total + {_d(0.1)} WHEN two_phones THEN total - {_d(0.1)} ELSE total END)) END AS score FROM summed),
  edges AS (SELECT *, CASE kind WHEN 'refused' THEN 'refused' WHEN 'authoritative' THEN 'accepted' ELSE CASE WHEN score >= {_d(0.85)} THEN 'review' ELSE 'below' END END AS route FROM scored)"""
#: Clusters: rows that accepted edges reach; every other matchable row is its own.
_CLUSTERED = f"""{_SCORED}, ties AS (SELECT a, b FROM edges WHERE route = 'accepted' UNION SELECT b, a FROM edges WHERE route = 'accepted'),
  reach AS (SELECT id, id AS other FROM named WHERE {_MATCH} UNION SELECT r.id, e.b FROM reach r JOIN ties e ON r.other = e.a),
  member AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id),
  review AS (SELECT e.* FROM edges e JOIN member p ON p.id = e.a JOIN member q ON q.id = e.b WHERE route = 'review' AND p.cluster <> q.cluster),
  merged AS (SELECT p.id AS a, q.id AS b FROM member p JOIN member q ON p.cluster = q.cluster AND p.id < q.id),
  truth AS (SELECT l.id AS a, r.id AS b FROM leads l JOIN leads r ON l.true_person_id = r.true_person_id AND l.id < r.id)"""

ORACLE_SQL["scored_edges"] = f"WITH RECURSIVE {_SCORED} SELECT a, b, kind, score, route FROM edges"
ORACLE_SQL["rule_refusals"] = f"WITH RECURSIVE {_SCORED} SELECT a, b, rule FROM ruled WHERE rule IS NOT NULL"
ORACLE_SQL["clean_clusters"] = f"""WITH RECURSIVE {_CLUSTERED}, inside AS (SELECT p.cluster, count(*) AS n FROM edges e JOIN member p ON p.id = e.a WHERE route = 'accepted' GROUP BY p.cluster)
  SELECT 'c-' || m.cluster AS id, string_agg(m.id, ' ' ORDER BY m.id) AS member_ids, count(*) AS row_count, 'authoritative' AS strength, max(n) AS n_edges FROM member m JOIN inside i ON i.cluster = m.cluster GROUP BY m.cluster"""
ORACLE_SQL["review_reasons"] = f"""WITH RECURSIVE {_CLUSTERED}, whys AS (
    SELECT a, b, 1 AS n, 'surname' AS rule, CASE WHEN x.nlast IS NOT NULL AND y.nlast IS NOT NULL AND surname >= {_d(0.9)} THEN 'match' ELSE 'mismatch' END AS verdict, CAST(NULL AS DOUBLE) AS weight FROM review
    UNION ALL SELECT a, b, 2, 'given name', CASE WHEN given >= {_d(0.85)} THEN 'match' ELSE 'mismatch' END, NULL FROM review
    UNION ALL SELECT a, b, 3, 'name', 'match', {_d(0.45)} * name_score FROM review
    UNION ALL SELECT a, b, 4, 'company', CASE WHEN company_score >= {_d(0.8)} THEN 'match' ELSE 'mismatch' END, {_d(0.3)} * company_score FROM review WHERE company_score IS NOT NULL
    UNION ALL SELECT a, b, 5, 'domain', 'match', {_d(0.15)} FROM review WHERE same_domain
    UNION ALL SELECT a, b, 6, 'phone', CASE WHEN same_seven THEN 'match' ELSE 'mismatch' END, CASE WHEN same_seven THEN {_d(0.1)} ELSE {_d(-0.1)} END FROM review WHERE same_seven OR two_phones)
  SELECT a, b, CAST(row_number() OVER (PARTITION BY a, b ORDER BY n) - 1 AS INT) AS place, rule, verdict, weight FROM whys"""
ORACLE_SQL["run_counts"] = f"""WITH RECURSIVE {_CLUSTERED}, n AS (SELECT (SELECT count(*) FROM leads) AS rows_in, (SELECT count(*) FROM member) AS m, (SELECT count(DISTINCT cluster) FROM member) AS clusters, (SELECT count(*) FROM merged) AS auto_merged,
    (SELECT count(*) FROM review) AS pending, (SELECT count(*) FROM edges WHERE route = 'refused') AS refused, (SELECT count(*) FROM met) AS comparisons, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM merged JOIN truth USING (a, b)) AS h)
  SELECT rows_in, rows_in - m AS quarantined, clusters, auto_merged, pending, refused, comparisons, CAST(m - clusters AS DOUBLE) / m AS dedup_rate, CAST(comparisons AS DOUBLE) / (m * (m - 1) // 2) AS comparison_ratio,
    CAST(h AS DOUBLE) / auto_merged AS auto_precision, CAST(h AS DOUBLE) / t AS auto_recall FROM n"""
ORACLE_SQL["clean_review"] = f"""WITH RECURSIVE {_CLUSTERED}, said AS (SELECT *, 'surname: ' || x.nlast || ' and ' || y.nlast || ' ' || printf('%.2f', surname) || ' | given name: ' || x.nfirst || ' and ' || y.nfirst || ' ' || printf('%.2f', given)
    || ' | name: both halves together ' || printf('%.2f', name_score) || CASE WHEN company_score IS NULL THEN '' ELSE ' | company: ' || x.fkey || ' and ' || y.fkey || ' ' || printf('%.2f', company_score) END
    || CASE WHEN same_domain THEN ' | domain: ' || x.site ELSE '' END || CASE WHEN same_seven THEN ' | phone: last seven digits ' || x.seven WHEN two_phones THEN ' | phone: ' || x.e164 || ' and ' || y.e164 || ': weak, as a person can have two' ELSE '' END AS reasons FROM review)
  SELECT printf('%.3f', score) AS score, '' AS decision, s.a AS row_a, p.full_name AS name_a, p.email AS email_a, p.phone AS phone_a, p.company AS company_a, s.b AS row_b, q.full_name AS name_b, q.email AS email_b, q.phone AS phone_b, q.company AS company_b, reasons
  FROM said s JOIN leads p ON p.id = s.a JOIN leads q ON q.id = s.b"""
_STEPS = ", ".join(f"({_d(t)})" for t in (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5))
ORACLE_SQL["threshold_sweep"] = f"""WITH RECURSIVE {_CLUSTERED}, steps(threshold) AS (VALUES {_STEPS}), queued AS (SELECT threshold, e.a, e.b, t.a IS NOT NULL AS true_ FROM steps JOIN edges e ON e.kind = 'probable' AND e.score >= threshold LEFT JOIN truth t ON t.a = e.a AND t.b = e.b),
  q AS (SELECT s.threshold, count(queued.a) AS n, count_if(coalesce(true_, FALSE)) AS h FROM steps s LEFT JOIN queued ON queued.threshold = s.threshold GROUP BY s.threshold),
  k AS (SELECT (SELECT count(*) FROM merged) AS p, (SELECT count(*) FROM truth) AS t, (SELECT count(*) FROM merged JOIN truth USING (a, b)) AS h)
  SELECT threshold, n AS queue, CAST(k.h AS DOUBLE) / p AS auto_precision, CAST(k.h AS DOUBLE) / t AS auto_recall, CAST(k.h + q.h AS DOUBLE) / (p + n) AS blind_precision, CAST(k.h + q.h AS DOUBLE) / t AS blind_recall FROM q, k"""
