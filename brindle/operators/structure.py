"""Similar bodies: equal structure, drifted copies, and odd values in families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Longer bodies meet by neighbourhoods, whatever edits they may differ by: each would be written so often.
THIN = 256


def equal_groups(bodies: DataFrame, by: str, least: int = 2) -> DataFrame:
    """(by, members, first): groups of bodies with equal structure; members are counted, not listed.
    Bodies without a structure are in none."""
    return bodies.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("members"), F.min("id").alias("first")).where(F.col("members") >= least)


def letters(tokens: Column, known: Column) -> Column:
    """A string with one code point a token: its place among the known tokens, past the surrogates."""
    place = lambda t: F.array_position(known, t)
    point = lambda n: F.when(n < 0xD700, n + 255).otherwise(n + 255 + 0x2000)
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(point(place(t))), 8, "0")), "UTF-32")), "")


def token_distance(a: Column, b: Column, bound: int) -> Column:
    """Edits between two arrays of tokens, -1 beyond the bound. What both begin and end with is cut off, and what is left
    of the two shares a lettering, so it holds for any number of different tokens in the table, and the engine's
    own bounded distance compares them."""
    be = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    differ = lambda p: F.array_position(F.zip_with(p["a"], p["b"], lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    begin = lambda p: be(differ(p), lambda n: F.when(n > 0, n).otherwise(F.least(F.size(p["a"]), F.size(p["b"])) + 1))
    back = lambda x, n: F.reverse(F.slice(x, n, F.size(x)))
    cut = lambda p: be(begin(p), lambda n: F.struct(back(p["a"], n).alias("a"), back(p["b"], n).alias("b")))
    middle = be(be(F.struct(a.alias("a"), b.alias("b")), cut), cut)
    return be(middle, lambda p: be(F.array_distinct(F.concat(p["a"], p["b"])), lambda k: F.levenshtein(letters(p["a"], k), letters(p["b"], k), bound)))


def shortened(tokens: Column) -> Column:
    """Hashes of an array and of what is left without one of its tokens: arrays one edit apart share one."""
    without = lambda k: F.xxhash64(F.concat(F.slice(tokens, F.lit(1), k - 1), F.slice(tokens, k + 1, F.size(tokens))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(tokens)), F.transform(F.sequence(F.lit(1), F.size(tokens)), without)))


def drift_pairs(bodies: DataFrame, budget: int = 28, ratio: float = 0.08, most: int | None = 5000) -> tuple[DataFrame, DataFrame]:
    """Pairs of bodies (id, tokens, hash) that differ by few edits, and whether the search was cut.

    Of equal bodies the one with the least id stands for all. A pair may differ by ``budget`` edits and by
    ``ratio`` of its shorter body. Where that is one edit, bodies meet by what is left without one of their tokens,
    so hardly more meet than are pairs. An edit touches two neighbourhoods, so two bodies within k edits share
    one of the 2k + 1 rarest neighbourhoods (hashes of neighbouring tokens; two alike by chance only meet more) of each, or have no more than
    2k both; bodies meet by these, which keeps what all bodies have in common out of the join. Then they
    pass the exact length gate and the gate of neighbourhoods not shared, and only survivors are compared,
    in the order of (length, id). ``most`` bounds the comparisons, as part of the feature, and the second
    frame tells whether any were left out. None compares them all.
    """
    held = bodies.where("tokens IS NOT NULL AND hash IS NOT NULL").groupBy("hash").agg(F.min(F.struct("id", "tokens")).alias("b")).select("hash", "b.*", F.size("b.tokens").cast("long").alias("n_tokens"))
    allowed = lambda n: F.least(F.lit(budget), F.floor(n * ratio + 1e-9)).cast("int")
    edits = allowed(F.col("n_tokens"))
    thin = lambda n: (allowed(n) == 1) & (n <= THIN)
    near = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tokens") - 2)), lambda k: F.xxhash64(F.get("tokens", k), F.get("tokens", k + 1))))
    held = held.withColumn("edits", edits).where("edits >= 1").withColumn("near", near)
    # the longer body of a thin one's pair may itself be thick
    variants = held.where(thin(F.col("n_tokens")) | thin(F.col("n_tokens") - 1)).select("id", "n_tokens", F.explode(shortened(F.col("tokens"))).alias("gram"))
    slim = variants.where(thin(F.col("n_tokens"))).select("gram", F.struct("n_tokens", "id").alias("a")).join(variants.select("gram", F.struct("n_tokens", "id").alias("b")).hint("merge"), "gram").where("a < b")
    slim = slim.select(F.least("a.id", "b.id").alias("x"), F.greatest("a.id", "b.id").alias("y"))
    thick = held.where(~thin(F.col("n_tokens")))
    each = thick.select("id", "edits", F.explode("near").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    rare = each.join(counts, "gram").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("n", "gram"))).where("place <= 2 * edits + 1")
    few = thick.where(F.size("near") <= 2 * F.col("edits"))  # these meet by their lengths
    left = rare.select("id", "gram", F.lit(False).alias("by_length")).unionByName(few.select("id", F.col("n_tokens").alias("gram"), F.lit(True).alias("by_length")))
    lengths = F.explode(F.sequence(F.col("n_tokens") - F.col("edits"), F.col("n_tokens") + F.col("edits")))
    right = rare.select("id", "gram", F.lit(False).alias("by_length")).unionByName(few.select("id", lengths.alias("gram"), F.lit(True).alias("by_length")))
    met = left.withColumnRenamed("id", "x").join(right.withColumnRenamed("id", "y"), ["gram", "by_length"]).where("x <> y")
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).unionByName(slim).distinct()
    side = lambda x: held.select(*[F.col(k).alias(f"{k}_{x}") for k in ("id", "tokens", "n_tokens", "edits", "near")])
    both = met.join(side("a").hint("merge"), F.col("x") == F.col("id_a")).join(side("b").hint("merge"), F.col("y") == F.col("id_b")).drop("x", "y")
    swap = F.struct("n_tokens_b", "id_b") < F.struct("n_tokens_a", "id_a")
    turned = both.select(*[F.when(swap, F.col(f"{k}_{p}")).otherwise(F.col(f"{k}_{q}")).alias(f"{k}_{q}") for k in ("id", "tokens", "n_tokens", "edits", "near") for p, q in (("b", "a"), ("a", "b"))])
    apart = F.greatest(F.size(F.array_except("near_a", "near_b")), F.size(F.array_except("near_b", "near_a")))
    survivors = turned.where((F.col("n_tokens_b") - F.col("n_tokens_a") <= F.col("edits_a")) & (apart <= 2 * F.col("edits_a")))
    cut = survivors.limit(0).select(F.lit(False).alias("truncated"))
    if most is not None:
        order = ["n_tokens_a", "id_a", "n_tokens_b", "id_b"]
        cut = survivors.select(*order).limit(most + 1).groupBy().agg((F.count("*") > most).alias("truncated"))
        survivors = survivors.orderBy(*order).limit(most)
    judged = survivors.withColumn("distance", token_distance(F.col("tokens_a"), F.col("tokens_b"), budget))
    share = F.col("distance") / F.greatest(F.lit(1), F.col("n_tokens_a"))
    return judged.withColumn("ratio", share).where((F.col("distance") >= 1) & (F.col("ratio") <= ratio)).select("id_a", "id_b", "distance", "ratio"), cut


def masked_minority(bodies: DataFrame, group: str, id_: str, values: str) -> DataFrame:
    """Odd values: in a group of three or more bodies with equally many values, a place with exactly two
    values of which one occurs once. Groups whose bodies differ in length give nothing."""
    sized = bodies.groupBy(group).agg(F.count("*").alias("_n"), F.min(F.size(values)).alias("_lo"), F.max(F.size(values)).alias("_hi")).where("_n >= 3 AND _lo = _hi")
    each = bodies.join(sized.select(group, "_n"), group).select(group, id_, "_n", F.posexplode(values).alias("place", "value"))
    counts = each.groupBy(group, "place", "value", "_n").agg(F.count("*").alias("n"), F.min(id_).alias(id_))
    pair = counts.groupBy(group, "place", "_n").agg(
        F.count("*").alias("_values"),
        F.min(F.struct("n", "value", id_)).alias("few"),
        F.max(F.struct("n", "value")).alias("many"),
    )
    return pair.where("_values = 2 AND few.n = 1 AND many.n > 1").select(group, "place", F.col(f"few.{id_}").alias(id_), F.col("few.value").alias("minority"), F.col("many.value").alias("majority"))
