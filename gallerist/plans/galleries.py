"""The gallery: people, samples, versions, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from gallerist.functions.names import normalized_name, strip, strip_sql, valid_name
from gallerist.plans.registry import query
from gallerist.storage import exact_quantiles

def people(t):
    """Enrolled and archived people, a redelivered row once."""
    return t("people").distinct()


def samples(t):
    return t("samples").select("id", "person_id", F.octet_length("vector").alias("bytes")).distinct()


@query("gallery_scan", """
WITH p AS (SELECT DISTINCT * FROM people), s AS (SELECT DISTINCT id, person_id, created_at, octet_length(vector) AS bytes FROM samples)
SELECT p.id AS person_id, p.name, p.name_key, s.id AS sample_id, s.bytes = 512 AS usable FROM p JOIN s ON s.person_id = p.id WHERE p.active = 1""")
def gallery_scan(t):
    """Templates of all active people: equi-join on the person."""
    p, s = people(t).filter("active = 1"), samples(t)
    return p.alias("p").join(s.alias("s"), F.col("s.person_id") == F.col("p.id")).select(F.col("p.id").alias("person_id"), "p.name", "p.name_key", F.col("s.id").alias("sample_id"), (F.col("s.bytes") == 512).alias("usable"))


@query("people_listing", """
WITH p AS (SELECT DISTINCT * FROM people), s AS (SELECT person_id, count(DISTINCT id) AS n FROM samples GROUP BY 1)
SELECT p.id, p.name, coalesce(s.n, 0) AS sample_count, p.created_at FROM p LEFT JOIN s ON s.person_id = p.id WHERE p.active = 1""")
def people_listing(t):
    """Active people with their number of samples, none included."""
    n = t("samples").groupBy("person_id").agg(F.countDistinct("id").alias("n"))
    return people(t).filter("active = 1").join(n, F.col("id") == F.col("person_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("sample_count"), "created_at")


@query("samples_per_person", """
WITH s AS (SELECT DISTINCT id, person_id, octet_length(vector) AS bytes, image IS NOT NULL AS img FROM samples)
SELECT person_id, count(*) AS samples, count(*) FILTER (WHERE bytes = 512) AS full_vectors, count(*) FILTER (WHERE img) AS with_image FROM s GROUP BY person_id""")
def samples_per_person(t):
    s = t("samples").select("id", "person_id", F.octet_length("vector").alias("bytes"), F.col("image").isNotNull().alias("img")).distinct()
    return s.groupBy("person_id").agg(F.count("*").alias("samples"), F.count_if(F.coalesce(F.col("bytes") == 512, F.lit(False))).alias("full_vectors"), F.count_if("img").alias("with_image"))


@query("name_keys", """
WITH n AS (SELECT DISTINCT label AS raw FROM manifest WHERE label IS NOT NULL), c AS (SELECT raw, regexp_replace(trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)), '[\\s\\x{a0}\\x{3000}]+', ' ', 'g') AS name FROM n)
SELECT raw, name, NOT regexp_matches(name, '\\pC') AND length(name) BETWEEN 1 AND 64 AS valid FROM c""".replace("\\\\", "\\"))
def name_keys(t):
    """Names as typed, with blanks collapsed, and whether they may be enrolled."""
    n = t("manifest").select(F.col("label").alias("raw")).filter("raw IS NOT NULL").distinct()
    return n.select("raw", normalized_name(F.col("raw")).alias("name"), valid_name(F.col("raw")).alias("valid"))


@query("upsert_plan", strip_sql("""
WITH n AS (SELECT lower(trim(label)) AS key, count(DISTINCT entry_id) AS entries FROM manifest WHERE section = 'gallery' AND trim(label) <> '' GROUP BY 1),
p AS (SELECT name_key, min(id) AS id FROM people WHERE active = 1 GROUP BY 1)
SELECT n.key, n.entries, p.id AS person_id, CASE WHEN p.id IS NULL THEN 'create' ELSE 'append' END AS action FROM n LEFT JOIN p ON p.name_key = n.key"""))
def upsert_plan(t):
    """Which gallery entries append to an active person and which create one."""
    key = F.lower(strip("label"))
    n = t("manifest").filter((F.col("section") == "gallery") & (strip("label") != "")).groupBy(key.alias("key")).agg(F.countDistinct("entry_id").alias("entries"))
    p = t("people").filter("active = 1").groupBy("name_key").agg(F.min("id").alias("id"))
    return n.join(p, n.key == p.name_key, "left").select("key", "entries", F.col("id").alias("person_id"), F.when(F.col("id").isNull(), "create").otherwise("append").alias("action"))


@query("restore_conflicts", """
WITH p AS (SELECT DISTINCT id, name_key, active FROM people)
SELECT a.id, a.name_key, EXISTS (SELECT 1 FROM p b WHERE b.active = 1 AND b.name_key = a.name_key) AS conflict FROM p a WHERE a.active = 0""")
def restore_conflicts(t):
    """Archived people, and whether an active name stands in their way."""
    p = t("people").select("id", "name_key", "active").distinct()
    live = p.filter("active = 1").select(F.col("name_key").alias("k")).distinct()
    return p.filter("active = 0").join(live, F.col("name_key") == F.col("k"), "left").select("id", "name_key", F.col("k").isNotNull().alias("conflict"))


@query("active_name_duplicates", "SELECT name_key, count(DISTINCT id) AS people FROM people WHERE active = 1 GROUP BY 1 HAVING count(DISTINCT id) > 1")
def active_name_duplicates(t):
    """Violations of the unique active name (an assertion: no rows)."""
    return t("people").filter("active = 1").groupBy("name_key").agg(F.countDistinct("id").alias("people")).filter("people > 1")


@query("orphan_samples", "SELECT DISTINCT s.id, s.person_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.id = s.person_id)")
def orphan_samples(t):
    """Samples of nobody (left anti join)."""
    s = t("samples").select("id", "person_id").distinct()
    return s.join(t("people").select(F.col("id").alias("pid")), F.col("person_id") == F.col("pid"), "left_anti")


@query("people_without_samples", "SELECT DISTINCT id, name FROM people p WHERE active = 1 AND NOT EXISTS (SELECT 1 FROM samples s WHERE s.person_id = p.id)")
def people_without_samples(t):
    return t("people").filter("active = 1").select("id", "name").distinct().join(t("samples").select("person_id"), F.col("id") == F.col("person_id"), "left_anti")


@query("gallery_meta", "SELECT max(value) FILTER (WHERE key = 'signature') AS signature, max(value) FILTER (WHERE key = 'dimension')::INT AS dimension, max(value) FILTER (WHERE key = 'schema')::INT AS schema_version, max(value) FILTER (WHERE key = 'revision')::BIGINT AS revision FROM meta")
def gallery_meta(t):
    """Signature, dimension, schema version and revision as one row."""
    v = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return t("meta").agg(v("signature").alias("signature"), v("dimension").cast("int").alias("dimension"), v("schema").cast("int").alias("schema_version"), v("revision").cast("bigint").alias("revision"))


QUALITY = """
WITH q AS (SELECT id, any_value(CASE WHEN json_valid(quality) THEN quality END) AS q FROM samples GROUP BY id),
v AS (SELECT id, (q->>'$.brightness')::DOUBLE AS b, (q->>'$.contrast')::DOUBLE AS c, (q->>'$.focus_score')::DOUBLE AS f, (q->>'$.face_size_ratio')::DOUBLE AS r FROM q)
"""


def quality(t):
    """Quality measures of every sample; null where the JSON is broken."""
    num = lambda k: F.expr(f"try_cast(get_json_object(q, '$.{k}') AS DOUBLE)")
    one = t("samples").groupBy("id").agg(F.max("quality").alias("q"))
    return one.select("id", num("brightness").alias("b"), num("contrast").alias("c"), num("focus_score").alias("f"), num("face_size_ratio").alias("r"))


@query("quality_gate", QUALITY + """
SELECT id, list_filter([CASE WHEN b < 45 THEN 'dark' END, CASE WHEN b > 220 THEN 'bright' END, CASE WHEN c < 22 THEN 'contrast' END, CASE WHEN f < 0.35 THEN 'blur' END, CASE WHEN r < 0.035 THEN 'small' END], lambda x: x IS NOT NULL) AS reasons,
 round(0.35 * least(1, greatest(0, f / 0.7)) + 0.25 * least(1, greatest(0, c / 44)) + 0.2 * least(1, greatest(0, r / 0.07)) + 0.2 * (1 - 0.5 * least(1, abs(b - 132.5) / 87.5)), 6) AS proxy FROM v""")
def quality_gate(t):
    """Reasons for refusing each sample, and its quality proxy."""
    from gallerist.functions.quality import proxy, reasons

    m = [F.col(x) for x in "bcfr"]
    return quality(t).select("id", reasons(*m).alias("reasons"), F.round(proxy(*m), 6).alias("proxy"))


@query("quality_policies", QUALITY + """
, w AS (SELECT id, [CASE WHEN b < 45 THEN 'dark' END, CASE WHEN b > 220 THEN 'bright' END, CASE WHEN c < 22 THEN 'contrast' END, CASE WHEN f < 0.35 THEN 'blur' END, CASE WHEN r < 0.035 THEN 'small' END] AS x FROM v)
SELECT 'none' AS policy, count(*) AS samples, count(*) AS accepted FROM w
UNION ALL SELECT 'brightness_only', count(*), count(*) FILTER (WHERE NOT list_has_any(x, ['dark', 'bright'])) FROM w
UNION ALL SELECT 'sharpness_only', count(*), count(*) FILTER (WHERE NOT list_contains(x, 'blur')) FROM w
UNION ALL SELECT 'full', count(*), count(*) FILTER (WHERE NOT list_has_any(x, ['dark', 'bright', 'contrast', 'blur', 'small'])) FROM w""")
def quality_policies(t):
    """Samples that each gate policy would accept."""
    from gallerist.functions.quality import POLICIES, reasons

    r = quality(t).select("id", reasons(*[F.col(x) for x in "bcfr"]).alias("x"))
    looks = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.array(*[F.lit(c).cast("string") for c in cs]).cast("array<string>").alias("looks")) for p, cs in POLICIES.items()]))
    rows = r.select("x", looks.alias("p")).select("p.policy", F.arrays_overlap("x", "p.looks").alias("refused"))
    return rows.groupBy("policy").agg(F.count("*").alias("samples"), F.count_if(~F.coalesce("refused", F.lit(False))).alias("accepted"))


@query("quality_reasons", QUALITY + """
, w AS (SELECT unnest([CASE WHEN b < 45 THEN 'dark' END, CASE WHEN b > 220 THEN 'bright' END, CASE WHEN c < 22 THEN 'contrast' END, CASE WHEN f < 0.35 THEN 'blur' END, CASE WHEN r < 0.035 THEN 'small' END]) AS reason FROM v)
SELECT reason, count(*) AS n FROM w WHERE reason IS NOT NULL GROUP BY 1""")
def quality_reasons(t):
    """How often each reason refuses a sample."""
    from gallerist.functions.quality import reasons

    return quality(t).select(F.explode(reasons(*[F.col(x) for x in "bcfr"])).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("quality_quartiles", QUALITY + """
SELECT round(quantile_cont(b, 0.25), 6) AS b25, round(quantile_cont(b, 0.5), 6) AS b50, round(quantile_cont(b, 0.75), 6) AS b75,
 round(quantile_cont(f, 0.25), 6) AS f25, round(quantile_cont(f, 0.5), 6) AS f50, round(quantile_cont(f, 0.75), 6) AS f75, count(b) AS n FROM v""")
def quality_quartiles(t):
    rows = quality(t).select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("x")) for c in "bf"])).alias("m")).select("m.c", "m.x")
    q = exact_quantiles(rows, "x", (0.25, 0.5, 0.75), ["c"])
    of = lambda c, i: F.round(F.max(F.when(F.col("c") == c, F.col("q")[i])), 6).alias(f"{c}{(25, 50, 75)[i]}")
    return q.agg(*[of(c, i) for c in "bf" for i in range(3)], F.coalesce(F.max(F.when(F.col("c") == "b", F.col("n"))), F.lit(0)).alias("n"))
