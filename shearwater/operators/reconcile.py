"""Comparing, merging and pruning versions of keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Last of each key: a partial aggregate, not a window over all rows."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """(key, change): new, deleted, or updated where a compared column differs (null-safe)."""
    a = old.select(F.col(key).alias("_k"), F.struct(*compared).alias("a"))
    b = new.select(key, F.struct(*compared).alias("b"))
    both = a.join(b, F.col("_k") == F.col(key), "full_outer")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "updated")
    return both.select(F.coalesce(key, "_k").alias(key), change.alias("change")).where("change is not null")


def upsert(
    old: DataFrame, new: DataFrame, key: str, overwrite: Sequence[str], keep_if_null: Sequence[str] = (), keep_old_if: dict[str, Column] | None = None,
    defaults: dict[str, Column] | None = None, stamp: tuple[str, Column] | None = None, id_column: str = "id",
) -> DataFrame:
    """One full-outer merge by ``key``.

    Columns of ``overwrite`` take the incoming value, null too; ``keep_if_null``
    only a non-null one; ``keep_old_if`` keeps the old value where its condition
    (over ``n.*`` and ``o.*``) holds.  Old ids stay, new rows are numbered after the largest id
    in key order, in range-partitioned blocks.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh, gone = F.col(f"o.{key}").isNull(), F.col(f"n.{key}").isNull()
    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key), F.col(f"o.{id_column}").alias(id_column)]
    for c in overwrite:
        value = F.col(f"n.{c}")
        if keep_old_if and c in keep_old_if:
            value = F.when(keep_old_if[c] & F.col(f"o.{c}").isNotNull(), F.col(f"o.{c}")).otherwise(value)
        out.append(F.when(gone, F.col(f"o.{c}")).otherwise(value).alias(c))
    for c in keep_if_null:
        value = F.coalesce(f"n.{c}", f"o.{c}")
        if defaults and c in defaults:
            value = F.when(fresh, F.coalesce(F.col(f"n.{c}"), defaults[c])).otherwise(value)
        out.append(value.alias(c))
    if stamp:
        out.append(F.when(gone, F.col(f"o.{stamp[0]}")).otherwise(stamp[1]).alias(stamp[0]))
    merged = both.select(*out)
    return numbered(merged, id_column, key)


#: Rows that get their numbers in one task.
NUMBERED = 200_000


def numbered(rows: DataFrame, id_column: str, key: str) -> DataFrame:
    """Give rows with a null id the numbers after the largest one, in an order that only depends on the key.

    The rows are stored once; ranks are counted inside hash blocks of about
    NUMBERED new rows and shifted by the blocks before, so no task sorts all
    rows.
    """
    rows = cut(rows)
    size = rows.agg(F.count_if(F.col(id_column).isNull()).alias("new"), F.coalesce(F.max(id_column), F.lit(0)).alias("top")).first()
    if not size.new:
        return rows
    new = rows.where(F.col(id_column).isNull()).withColumn("_b", F.pmod(F.xxhash64(key), F.lit(-(-size.new // NUMBERED))))
    ahead = new.groupBy("_b").agg(F.count("*").alias("_n"))
    ahead = ahead.withColumn("_ahead", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))  # a row a block
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    fresh = new.withColumn("_r", rank).join(F.broadcast(ahead), "_b").withColumn(id_column, F.lit(size.top) + F.col("_ahead") + F.col("_r"))
    return rows.where(F.col(id_column).isNotNull()).unionByName(fresh.select(*rows.columns))


def prune(rows: DataFrame, seen: DataFrame, site: str, key: str, complete: DataFrame | None = None) -> DataFrame:
    """Rows without the ones that have disappeared.

    Only sites with at least one seen row are pruned (of complete runs, where
    ``complete`` lists those); other and null sites stay untouched.
    """
    sites = seen.select(F.col(site).alias("_s")).distinct()
    if complete is not None:
        sites = sites.join(complete.select(F.col(site).alias("_s")).distinct(), "_s", "left_semi")
    marked = rows.join(sites.withColumn("_in", F.lit(True)), rows[site] == F.col("_s"), "left").drop("_s")
    kept = marked.join(seen.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(True)), F.col(key) == F.col("_k"), "left")
    return kept.where(F.col("_in").isNull() | F.col("_seen").isNotNull()).select(*rows.columns)


def first_claim(claims: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """(key, owner): the first owner in order that claims a key."""
    return claims.groupBy(key).agg(F.min_by(owner, F.struct(order, owner)).alias(owner))


#: Hosts whose lists are broadcast.
HOSTS = 100_000


def prefix_attribution(rows: DataFrame, lists: DataFrame, url: str, list_url: str, order: str) -> DataFrame:
    """The first list whose URL starts the row's URL; of equal places the smallest URL.

    Each host's lists (a handful of configured ones) are an array, so a row
    meets them once and is never grouped: repeated rows stay apart, columns of
    any type come along, and a frequent host is no single task's.
    """
    from ..functions import web

    own = lists.select(web.authority(F.col(list_url)).alias("_g"), F.struct(F.col(order).alias("at"), F.col(list_url).alias("url")).alias("l"))
    own = own.groupBy("_g").agg(F.collect_set("l").alias("_lists"))
    if own.limit(HOSTS + 1).count() <= HOSTS:
        own = F.broadcast(own)
    met = rows.withColumn("_h", web.authority(F.col(url))).join(own, F.col("_h") == F.col("_g"))
    hit = F.array_min(F.filter("_lists", lambda x: F.col(url).startswith(x["url"])))["url"]
    return met.select(*rows.columns, hit.alias(list_url)).where(F.col(list_url).isNotNull())


def audit(left: DataFrame, right: DataFrame, key: str, compared: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(key, status) and (key, field, left_value, right_value) of mismatches, from one full-outer join."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    status = both.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        F.when(F.col(f"a.{key}").isNull(), "right_only").when(F.col(f"b.{key}").isNull(), "left_only").otherwise("matched").alias("status"),
    )
    text = lambda side, c: F.nullif(F.trim(F.col(f"{side}.{c}").cast("string")), F.lit(""))
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), text("a", c).alias("left_value"), text("b", c).alias("right_value")) for c in compared))
    wrong = (
        both.where(F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()).select(F.col(f"a.{key}").alias(key), F.inline(pairs))
        .where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    )
    return status, wrong


def ordered_distinct(parts: Sequence[DataFrame], keys: Sequence[str], position: str) -> DataFrame:
    """Union in order, each key once at its first place."""
    every = None
    for i, p in enumerate(parts):
        p = p.select(*keys, F.struct(F.lit(i).alias("part"), F.col(position).alias("pos")).alias("at"))
        every = p if every is None else every.unionByName(p)
    return every.groupBy(*keys).agg(F.min("at").alias("at")).select(*keys, F.col("at.part").alias("part"), F.col("at.pos").alias("pos"))


def right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of both, each key once; where both have it the right side's row is taken whole."""
    return left.join(right.select(key), key, "left_anti").unionByName(right, allowMissingColumns=True)


def reused(listed: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(records of ``known`` that are listed again, listed rows that have to be extracted)."""
    once = listed.dropDuplicates([key])
    return known.join(once.select(key), key, "left_semi"), once.join(known.select(key), key, "left_anti")


def capped(parts: Sequence[DataFrame], key: str, position: str, cap: int = 3, attempted: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """(key, part, pos, target): candidates of all parts in order, each once; the first ``cap`` that weren't attempted are targets.

    Only the ``cap`` targets are sorted out of all candidates.  With
    ``enabled`` false there are candidates but no targets.
    """
    seen = ordered_distinct(parts, [key], position)
    open_ = seen if attempted is None else seen.join(attempted.select(key).distinct(), key, "left_anti")
    first = open_.orderBy("part", "pos", key).limit(cap if enabled else 0).select(key, F.lit(True).alias("_t"))
    return seen.join(F.broadcast(first), key, "left").select(key, "part", "pos", F.coalesce("_t", F.lit(False)).alias("target"))


def first_of(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each combination of keys (nulls are equal), the first in order."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(order)).alias("_r")).select("_r.*")


def first_matches(records: DataFrame, preferences: DataFrame, shares: int = 16, by: str = "id") -> DataFrame:
    """Records x preferences where null means any.

    Species is spread to an equality key (a preference without one stands for
    all three), so this is a hash join with a residual, not a nested loop.
    Three species are few keys: records are dealt over ``shares`` parts of each
    by a hash of ``by``, and preferences are repeated for each part.
    """
    kinds = F.when(F.col("p_species").isNull(), F.array(F.lit("犬"), F.lit("猫"), F.lit("その他"))).otherwise(F.array("p_species"))
    p = preferences.withColumn("_kind", F.explode(kinds)).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    age = F.col("age_months")
    any_of = F.col("prefectures").isNull() | (F.size("prefectures") == 0) | F.exists("prefectures", lambda x: F.col("location").contains(x))
    fits = (
        (F.col("species") == F.col("_kind")) & (F.pmod(F.xxhash64(records[by]), F.lit(shares)) == F.col("_share")) & any_of & (F.col("age_min").isNull() | (age >= F.col("age_min"))) & (F.col("age_max").isNull() | (age <= F.col("age_max")))
        & (F.col("p_size").isNull() | (F.col("size") == F.col("p_size"))) & (F.col("p_sex").isNull() | (F.col("sex") == F.col("p_sex")))
    )
    return records.join(p, fits)


#: Classes of criteria that are broadcast: some megabytes.
CLASSES = 20_000
#: What a subscriber asks for; null means any.
CRITERIA = ("p_species", "prefectures", "age_min", "age_max", "p_size", "p_sex")


def criteria_classes(preferences: DataFrame, user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(class_id, criteria..., users) and (user, class_id): subscribers with equal criteria are one class.

    A class is named by its smallest user.  Places are compared as sets; a user
    with several preferences is a member of several classes.
    """
    places = F.when(F.size("prefectures") > 0, F.array_sort(F.array_distinct("prefectures")))
    p = preferences.select(user, *CRITERIA).withColumn("prefectures", places)
    classes = p.groupBy(*CRITERIA).agg(F.min(user).alias("class_id"), F.count_distinct(user).alias("users"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in CRITERIA]
    members = p.alias("p").join(classes.alias("c"), same).select(F.col(f"p.{user}").alias(user), "class_id").distinct()
    return classes, members


def class_matches(records: DataFrame, classes: DataFrame, by: str = "id") -> DataFrame:
    """J02 by classes: records x classes of criteria, a pair for each that fit; users come in by the membership table.

    Classes are counted: up to CLASSES of them are broadcast and hashed by
    species, so records aren't shuffled.  Beyond, records are dealt over as
    many shares as the session has shuffle partitions, and classes are repeated
    for each.
    """
    kinds = F.when(F.col("p_species").isNull(), F.array(F.lit("犬"), F.lit("猫"), F.lit("その他"))).otherwise(F.array("p_species"))
    p = classes.withColumn("_kind", F.explode(kinds))
    age = F.col("age_months")
    fits = (
        (F.col("species") == F.col("_kind")) & (F.col("prefectures").isNull() | F.exists("prefectures", lambda x: F.col("location").contains(x))) & (F.col("age_min").isNull() | (age >= F.col("age_min")))
        & (F.col("age_max").isNull() | (age <= F.col("age_max"))) & (F.col("p_size").isNull() | (F.col("size") == F.col("p_size"))) & (F.col("p_sex").isNull() | (F.col("sex") == F.col("p_sex")))
    )
    if classes.count() <= CLASSES:
        return records.join(F.broadcast(p), fits)
    shares = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = p.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return records.join(p, fits & (F.pmod(F.xxhash64(records[by]), F.lit(shares)) == F.col("_share")))


def unnotified(matches: DataFrame, members: DataFrame, history: DataFrame, user: str = "user_id", key: str = "source_url", groups: DataFrame | None = None) -> DataFrame:
    """(user, n): matched records of each user that aren't in its history (user, key), without listing the pairs.

    Matches are counted by class; of the history only what its user's class
    matches is taken off.  Keys are unique among the records.  With ``groups``
    (user, group) the history is (group, key): what each user of a group was
    told; a user is in one group at most.
    """
    told_to = user if groups is None else "group"
    mine = members if groups is None else members.join(groups.select(user, "group"), user, "left")
    total = mine.join(matches.groupBy("class_id").agg(F.count("*").alias("m")), "class_id")
    once = history.select(told_to, key).distinct()
    if groups is None:
        told = once.join(members, user).join(matches.select("class_id", key), ["class_id", key], "left_semi")
    else:
        # matches are repeated for the groups of their class, never the history for the classes of its group
        shown = matches.select("class_id", key).join(mine.select("group", "class_id").distinct(), "class_id")
        told = shown.join(once, ["group", key], "left_semi")
    off = told.groupBy(told_to, "class_id").agg(F.count("*").alias("t"))
    left = total.join(off, [told_to, "class_id"], "left").select(user, (F.col("m") - F.coalesce("t", F.lit(0))).alias("n"))
    return left.groupBy(user).agg(F.sum("n").alias("n")).where("n > 0")


def notified(matches: DataFrame, members: DataFrame, history: DataFrame, results: DataFrame, user: str = "user_id", key: str = "source_url") -> DataFrame:
    """One row of matches, skipped, sent and failed, by classes: no pair of user and record is listed.

    Pairs of ``history`` are skipped; of the others those whose user has
    ``ok`` false in ``results`` (user, ok), or isn't there, have failed.
    """
    left = unnotified(matches, members, history, user, key).join(results, user, "left")
    ok = F.coalesce("ok", F.lit(False))
    went = left.agg(F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("sent"), F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("failed"))
    total = matches.groupBy("class_id").agg(F.count("*").alias("m")).join(members.groupBy("class_id").agg(F.count("*").alias("users")), "class_id").agg(F.coalesce(F.sum(F.col("m") * F.col("users")), F.lit(0)).alias("matches"))
    return total.crossJoin(went).select("matches", (F.col("matches") - F.col("sent") - F.col("failed")).alias("skipped"), "sent", "failed")  # one row each
