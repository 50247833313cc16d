"""Splits, duplicates and leakage in the picture manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gallerist.functions.names import strip, strip_sql
from gallerist.plans import registry


def query(name: str, sql: str | None = None):
    return registry.query(name, strip_sql(sql) if sql else None)

M = "WITH m AS (SELECT DISTINCT * FROM manifest) "
P = "WITH p AS (SELECT DISTINCT * FROM pair_manifest) "


def manifest(t, *cols: str):
    """Entries, a redelivered row once.  A redelivered row repeats its key and
    every field, so only the key and the columns in use are read and shuffled."""
    return t("manifest").select("entry_id", *cols).distinct()


def pairs(t, *cols: str):
    return t("pair_manifest").select("pair_id", *cols).distinct()


def split_pair():
    """Each unordered pair of different splits once, in alphabetical order."""
    return (F.col("a.split") < F.col("b.split")) & (F.col("a.entry_id") != F.col("b.entry_id"))


@query("section_counts", M + "SELECT split, section, source, count(*) AS entries, count(label) AS labelled, count(DISTINCT label) AS labels FROM m GROUP BY 1, 2, 3")
def section_counts(t):
    return manifest(t, "split", "section", "source", "label").groupBy("split", "section", "source").agg(F.count("*").alias("entries"), F.count("label").alias("labelled"), F.countDistinct("label").alias("labels"))


@query("manifest_faults", M + """SELECT count(*) FILTER (WHERE section = 'gallery' AND label IS NULL) AS gallery_without_label, count(*) FILTER (WHERE label IS NULL AND subject_id IS NULL) AS nameless,
 count(*) FILTER (WHERE sha256 IS NULL) AS without_digest, count(*) FILTER (WHERE NOT regexp_full_match(sha256, '[0-9a-f]{64}')) AS bad_digest, count(*) FILTER (WHERE dhash64 IS NULL) AS without_hash,
 count(*) FILTER (WHERE (split = 'train') <> (section = 'gallery')) AS split_section_mismatch FROM m""")
def manifest_faults(t):
    """Violations of the manifest's rules, counted."""
    m = manifest(t, "split", "section", "label", "subject_id", "sha256", "dhash64")
    c = lambda e: F.count_if(F.coalesce(e, F.lit(False)))
    none = F.col("label").isNull()
    return m.agg(
        c((F.col("section") == "gallery") & none).alias("gallery_without_label"), c(none & F.col("subject_id").isNull()).alias("nameless"), c(F.col("sha256").isNull()).alias("without_digest"),
        c(~F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("bad_digest"), c(F.col("dhash64").isNull()).alias("without_hash"), c((F.col("split") == "train") != (F.col("section") == "gallery")).alias("split_section_mismatch"),
    )


@query("digest_duplicates", M + "SELECT sha256, count(*) AS entries, count(DISTINCT split) AS splits, min(entry_id) AS first_entry FROM m WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def digest_duplicates(t):
    """Pictures that occur more than once, and in how many splits."""
    return manifest(t, "split", "sha256").filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("entries"), F.countDistinct("split").alias("splits"), F.min("entry_id").alias("first_entry")).filter("entries > 1")


@query("digest_leaks", M + "SELECT a.split AS split_a, b.split AS split_b, count(*) AS pairs FROM m a JOIN m b ON a.sha256 = b.sha256 AND a.split < b.split GROUP BY 1, 2")
def digest_leaks(t):
    """Pairs of entries of different splits with the same digest."""
    g = manifest(t, "split", "sha256").filter("sha256 IS NOT NULL").groupBy("sha256", "split").agg(F.count("*").alias("n"))
    a, b = g.alias("a"), g.alias("b")  # counts meet instead of rows
    pairs_of = a.join(b, (F.col("a.sha256") == F.col("b.sha256")) & (F.col("a.split") < F.col("b.split")))
    return pairs_of.groupBy(F.col("a.split").alias("split_a"), F.col("b.split").alias("split_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("pairs"))


@query("subject_leaks", M + "SELECT lower(trim(coalesce(label, subject_id))) AS subject, count(DISTINCT split) AS splits, count(*) AS entries FROM m WHERE coalesce(label, subject_id) IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def subject_leaks(t):
    """Subjects that occur in several splits (group, having)."""
    s = F.lower(strip(F.coalesce("label", "subject_id")))
    return manifest(t, "split", "label", "subject_id").withColumn("subject", s).filter("subject IS NOT NULL").groupBy("subject").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("entries")).filter("splits > 1")


@query("session_leaks", M + "SELECT lower(trim(session_id)) AS session, count(DISTINCT split) AS splits, count(DISTINCT coalesce(label, subject_id)) AS subjects FROM m WHERE trim(session_id) <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def session_leaks(t):
    s = F.lower(strip("session_id"))
    return manifest(t, "split", "label", "subject_id", "session_id").withColumn("session", s).filter("session <> ''").groupBy("session").agg(F.countDistinct("split").alias("splits"), F.countDistinct(F.coalesce("label", "subject_id")).alias("subjects")).filter("splits > 1")


@query("near_duplicate_warnings", M + """, s AS (SELECT entry_id, split, lower(trim(coalesce(label, subject_id))) AS subject, dhash64 FROM m WHERE dhash64 IS NOT NULL)
SELECT a.entry_id AS entry_a, b.entry_id AS entry_b, a.subject, bit_count(xor(a.dhash64, b.dhash64))::INT AS bits FROM s a JOIN s b ON a.subject = b.subject AND a.split < b.split WHERE bit_count(xor(a.dhash64, b.dhash64)) <= 4""")
def near_duplicate_warnings(t):
    """Same subject, different split, difference hashes within four bits.  Of
    five chunks one stays equal, so two entries meet under a subject and an
    equal chunk (12 or 13 bits), not under the subject alone, and are reported
    by the first chunk they share.  Neither side is ever broadcast: a plan
    takes a side for as small as it is before it is multiplied."""
    s = manifest(t, "split", "label", "subject_id", "dhash64").filter("dhash64 IS NOT NULL").select("entry_id", "split", F.lower(strip(F.coalesce("label", "subject_id"))).alias("subject"), "dhash64").filter("subject IS NOT NULL")
    masks = [sum(1 << i for i in range(64) if i * 5 // 64 == c) for c in range(5)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    s = s.select("*", F.posexplode(masks).alias("slot", "mask")).select("entry_id", "split", "subject", "dhash64", "slot", F.xxhash64("subject", "slot", F.col("dhash64").bitwiseAND(F.col("mask"))).alias("key"))
    differ = F.col("a.dhash64").bitwiseXOR(F.col("b.dhash64"))
    bits = F.bit_count(differ)
    same = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.slot") == F.col("b.slot"))
    j = s.alias("a").hint("merge").join(s.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & same & (F.col("a.split") < F.col("b.split")) & (bits <= 4))
    first = F.array_min(F.filter(F.transform(masks, lambda m, i: F.struct(i.alias("i"), (m.bitwiseAND(F.col("x")) == 0).alias("same"))), lambda e: e["same"]))["i"]
    j = j.select(F.col("a.entry_id").alias("entry_a"), F.col("b.entry_id").alias("entry_b"), "a.subject", bits.alias("bits"), "a.slot", differ.alias("x"))
    return j.filter(F.col("slot") == first).select("entry_a", "entry_b", "subject", "bits")


@query("split_overlap_labels", M + "SELECT DISTINCT lower(trim(label)) AS label FROM m WHERE split = 'train' AND label IS NOT NULL INTERSECT SELECT DISTINCT lower(trim(label)) FROM m WHERE split = 'test' AND label IS NOT NULL")
def split_overlap_labels(t):
    """Labels of both train and test (intersect)."""
    m = manifest(t, "split", "label").filter("label IS NOT NULL").select(F.lower(strip("label")).alias("label"), "split")
    return m.filter("split = 'train'").select("label").intersect(m.filter("split = 'test'").select("label"))


@query("test_only_labels", M + "SELECT DISTINCT lower(trim(label)) AS label FROM m WHERE split = 'test' AND label IS NOT NULL EXCEPT SELECT DISTINCT lower(trim(label)) FROM m WHERE split = 'train' AND label IS NOT NULL")
def test_only_labels(t):
    """Labels of test that train lacks (except)."""
    m = manifest(t, "split", "label").filter("label IS NOT NULL").select(F.lower(strip("label")).alias("label"), "split")
    return m.filter("split = 'test'").select("label").exceptAll(m.filter("split = 'train'").select("label")).distinct().join(m.filter("split = 'train'").select("label"), "label", "left_anti")


@query("condition_counts", M + "SELECT regexp_replace(lower(trim(condition)), '[ _-]', '', 'g') AS condition, count(*) AS entries, count(DISTINCT split) AS splits FROM m GROUP BY 1")
def condition_counts(t):
    c = F.regexp_replace(F.lower(strip("condition")), "[ _-]", "")
    return manifest(t, "split", "condition").groupBy(c.alias("condition")).agg(F.count("*").alias("entries"), F.countDistinct("split").alias("splits"))


@query("collection_status", M + """SELECT coalesce(label, subject_id) AS subject, split, count(*) AS entries, count(*) FILTER (WHERE captured_at_utc IS NULL) AS no_time, count(*) FILTER (WHERE session_id IS NULL OR trim(session_id) = '') AS no_session
FROM m GROUP BY 1, 2 HAVING count(*) FILTER (WHERE captured_at_utc IS NULL) + count(*) FILTER (WHERE session_id IS NULL OR trim(session_id) = '') > 0""")
def collection_status(t):
    """Subjects and splits with missing capture data."""
    g = manifest(t, "split", "label", "subject_id", "session_id", "captured_at_utc").groupBy(F.coalesce("label", "subject_id").alias("subject"), "split").agg(F.count("*").alias("entries"), F.count_if(F.col("captured_at_utc").isNull()).alias("no_time"), F.count_if(F.coalesce(strip("session_id") == "", F.lit(True))).alias("no_session"))
    return g.filter("no_time + no_session > 0")


@query("one_row_per_photo", M + "SELECT lower(image) AS photo, min(entry_id) AS entry_id, min(condition) AS condition FROM m GROUP BY 1 HAVING count(DISTINCT condition) <= 1")
def one_row_per_photo(t):
    """One entry per photo; photos with conflicting conditions are dropped."""
    g = manifest(t, "image", "condition").groupBy(F.lower("image").alias("photo")).agg(F.min("entry_id").alias("entry_id"), F.min("condition").alias("condition"), F.countDistinct("condition").alias("n"))
    return g.filter("n <= 1").drop("n")


@query("sample_links", M + ", s AS (SELECT DISTINCT id, person_id FROM samples) SELECT m.entry_id, m.sample_id, s.person_id, s.id IS NULL AS broken FROM m LEFT JOIN s ON s.id = m.sample_id WHERE m.sample_id IS NOT NULL")
def sample_links(t):
    """Gallery pictures and the samples made from them."""
    s = t("samples").select("id", "person_id").distinct()
    return manifest(t, "sample_id").filter("sample_id IS NOT NULL").join(s, F.col("sample_id") == F.col("id"), "left").select("entry_id", "sample_id", "person_id", F.col("id").isNull().alias("broken"))


@query("pair_faults", P + """SELECT count(*) FILTER (WHERE left_image = right_image) AS self_pairs, count(*) FILTER (WHERE genuine IS NULL) AS without_truth,
 count(*) FILTER (WHERE genuine <> (lower(trim(left_subject_id)) = lower(trim(right_subject_id)))) AS contradictions, count(*) FILTER (WHERE left_session_id = right_session_id AND genuine) AS same_session_genuine FROM p""")
def pair_faults(t):
    """Violations of the pair manifest's rules, counted."""
    c = lambda e: F.count_if(F.coalesce(e, F.lit(False)))
    same = F.lower(strip("left_subject_id")) == F.lower(strip("right_subject_id"))
    return pairs(t, "left_image", "right_image", "left_subject_id", "right_subject_id", "left_session_id", "right_session_id", "genuine").agg(c(F.col("left_image") == F.col("right_image")).alias("self_pairs"), c(F.col("genuine").isNull()).alias("without_truth"), c(F.col("genuine") != same).alias("contradictions"), c((F.col("left_session_id") == F.col("right_session_id")) & F.col("genuine")).alias("same_session_genuine"))


@query("repeated_pairs", P + "SELECT least(left_image, right_image) AS image_a, greatest(left_image, right_image) AS image_b, count(*) AS pairs, min(pair_id) AS first_pair FROM p GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_pairs(t):
    """Unordered pairs of pictures that occur under several ids."""
    return pairs(t, "left_image", "right_image").groupBy(F.least("left_image", "right_image").alias("image_a"), F.greatest("left_image", "right_image").alias("image_b")).agg(F.count("*").alias("pairs"), F.min("pair_id").alias("first_pair")).filter("pairs > 1")


@query("pair_details", """WITH p AS (SELECT DISTINCT * FROM pair_manifest), m AS (SELECT image, min(sha256) AS digest, min(dhash64) AS h FROM (SELECT DISTINCT * FROM manifest) GROUP BY 1)
SELECT p.pair_id, p.split, a.digest IS NOT NULL AS left_known, b.digest IS NOT NULL AS right_known, bit_count(xor(a.h, b.h))::INT AS bits FROM p LEFT JOIN m a ON a.image = p.left_image LEFT JOIN m b ON b.image = p.right_image""")
def pair_details(t):
    """Both pictures of every pair looked up in the manifest."""
    m = manifest(t, "image", "sha256", "dhash64").groupBy("image").agg(F.min("sha256").alias("digest"), F.min("dhash64").alias("h"))
    a, b = m.select(*[F.col(c).alias("a_" + c) for c in m.columns]), m.select(*[F.col(c).alias("b_" + c) for c in m.columns])
    j = pairs(t, "split", "left_image", "right_image").join(a, F.col("left_image") == F.col("a_image"), "left").join(b, F.col("right_image") == F.col("b_image"), "left")
    return j.select("pair_id", "split", F.col("a_digest").isNotNull().alias("left_known"), F.col("b_digest").isNotNull().alias("right_known"), F.bit_count(F.col("a_h").bitwiseXOR(F.col("b_h"))).alias("bits"))


@query("pair_usability", P + """SELECT split, genuine, count(*) AS pairs, count(*) FILTER (WHERE left_session_id IS NULL AND right_session_id IS NULL) AS both_missing, count(*) FILTER (WHERE left_session_id IS NULL AND right_session_id IS NOT NULL) AS left_missing, count(*) FILTER (WHERE left_session_id IS NOT NULL AND right_session_id IS NULL) AS right_missing FROM p GROUP BY 1, 2""")
def pair_usability(t):
    """Which side of the pairs lacks its session, by split and truth."""
    a, b = F.col("left_session_id").isNull(), F.col("right_session_id").isNull()
    return pairs(t, "split", "genuine", "left_session_id", "right_session_id").groupBy("split", "genuine").agg(F.count("*").alias("pairs"), F.count_if(a & b).alias("both_missing"), F.count_if(a & ~b).alias("left_missing"), F.count_if(~a & b).alias("right_missing"))


@query("subject_pseudonyms", P + "SELECT split, sha256(split || chr(0) || lower(left_subject_id)) AS pseudonym, count(*) AS pairs FROM p WHERE left_subject_id IS NOT NULL GROUP BY split, lower(left_subject_id)".replace("chr(0)", "chr(1)"))
def subject_pseudonyms(t):
    """Pairs per pseudonymous left subject, salted by split."""
    g = pairs(t, "split", "left_subject_id").filter("left_subject_id IS NOT NULL").groupBy("split", F.lower("left_subject_id").alias("s")).agg(F.count("*").alias("pairs"))
    return g.select("split", F.sha2(F.concat("split", F.char(F.lit(1)), "s"), 256).alias("pseudonym"), "pairs")


@query("pair_components", """WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(left_subject_id)) AS a, lower(trim(right_subject_id)) AS b FROM pair_manifest WHERE left_subject_id IS NOT NULL AND right_subject_id IS NOT NULL),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
c AS (SELECT a AS s, a AS r FROM n UNION SELECT c.s, n.b FROM c JOIN n ON n.a = c.r)
SELECT s AS subject, min(r) AS component FROM c GROUP BY 1""")
def pair_components(t):
    """Subjects linked by pairs, directly or through others; a component is
    named by its smallest subject.  Subjects become numbers by their rank."""
    from gallerist.operators.components import connected_components
    from gallerist.storage import materialize, with_rank

    s = lambda side: F.lower(strip(f"{side}_subject_id"))
    e = pairs(t, "left_subject_id", "right_subject_id").select(s("left").alias("a"), s("right").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    names = materialize(with_rank(e.selectExpr("a AS s").union(e.selectExpr("b AS s")).distinct(), ["s"], name="i"), "names")
    u, v = names.select(F.col("s").alias("a"), F.col("i").alias("u")), names.select(F.col("s").alias("b"), F.col("i").alias("v"))
    roots = connected_components(e.join(u, "a").join(v, "b"))
    top = names.select(F.col("i").alias("root"), F.col("s").alias("component"))
    return roots.join(names, roots.node == names.i).join(top, "root").select(F.col("s").alias("subject"), "component")


@query("adjacent_pairs", """WITH l AS (SELECT lower(trim(label)) AS label, min(entry_id) AS entry FROM manifest WHERE trim(label) <> '' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY label) - 1 AS i FROM l)
SELECT a.label AS left_label, b.label AS right_label, a.entry AS left_entry, b.entry AS right_entry FROM r a JOIN r b ON b.i = a.i + 1 WHERE a.i % 2 = 0""")
def adjacent_pairs(t):
    """Impostor pairs of neighbours in the order of labels, by global ranks."""
    from gallerist.storage import with_rank

    key = F.lower(strip("label"))
    l = t("manifest").filter(strip("label") != "").groupBy(key.alias("label")).agg(F.min("entry_id").alias("entry"))
    r = with_rank(l, ["label"], name="i").withColumn("k", F.floor(F.col("i") / 2))
    side = lambda n: F.max(F.when(F.col("i") % 2 == n, F.struct("label", "entry")))
    g = r.groupBy("k").agg(side(0).alias("a"), side(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return g.select(F.col("a.label").alias("left_label"), F.col("b.label").alias("right_label"), F.col("a.entry").alias("left_entry"), F.col("b.entry").alias("right_entry"))
