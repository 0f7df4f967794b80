"""Splits that keep related records together.

Nodes of the graph are keys (what records share) and spellings (the raw content a record's
keys were read from); a spelling is linked to each of its keys, and a record that came with
several spellings links them. Records of one spelling are one node, so a group of copies
costs one link. Components come from hash-to-min: every node starts with itself and its
neighbours as its cluster; each round it sends its cluster to the cluster's smallest member
and that member to the whole cluster, until nothing changes. Clusters are rows ``(v, u)``,
never lists; nodes whose cluster holds more than a thousandth of all rows (so at most a
thousand) get their minimum by broadcast, and their rows stay where they are.

Components then go to splits by weighted rendezvous hashing. One hash can miss the shares
when a component holds a tenth of all records, so ``seeds`` salts are tried together over the
component sizes, their weights are corrected ``corrections`` times by what each split got too
much or too little, and the salt and weights that come nearest to the shares serve for all
components alike.

A record with no key is a component of its own; a null record id belongs nowhere and is
left out; repeated ids count once (their keys are joined); an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOT_SHARE = 0.001
SEEDS = 32
CORRECTIONS = 3


def links_of(records: DataFrame, record_id: str, keys: Column, spelling: Column | None = None) -> DataFrame:
    """``a, b``: spellings linked to their keys, and the keyed spellings of one record to the record.

    ``spelling`` must determine ``keys``; without it the list of keys itself is the spelling.
    """
    kept = _keyed(records, record_id, keys, spelling).where("size(keys) > 0")
    own = kept.select("spelling", "keys").distinct().select(F.concat(F.lit("spelling:"), "spelling").alias("a"), F.explode("keys").alias("k")).select("a", F.concat(F.lit("key:"), "k").alias("b"))
    several = kept.groupBy("record_id").agg(F.min("spelling").alias("x"), F.max("spelling").alias("y")).where("x <> y").select("record_id")
    again = kept.join(several, "record_id", "left_semi").select(F.concat(F.lit("record:"), "record_id").alias("a"), F.concat(F.lit("spelling:"), "spelling").alias("b")).distinct()
    return own.unionByName(again)


def _keyed(records: DataFrame, record_id: str, keys: Column, spelling: Column | None) -> DataFrame:
    clean = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(keys, F.array().cast("array<string>")))))
    spelled = F.md5(F.coalesce(spelling, F.lit("")) if spelling is not None else F.to_json(clean))
    return records.where(F.col(record_id).isNotNull()).select(F.col(record_id).cast("string").alias("record_id"), clean.alias("keys"), spelled.alias("spelling"))


def components(links: DataFrame, hot_share: float = HOT_SHARE, rounds: list | None = None) -> DataFrame:
    """``node, component`` of the nodes of ``links(a, b)``; the component is its smallest node.

    ``rounds``, if given, receives the number of cluster rows after each round.
    """
    both = links.where("a is not null and b is not null and a <> b").select(F.explode(F.array(*[F.struct(F.col(x).alias("v"), F.col(y).alias("u")) for x in "ab" for y in "ab"])).alias("l"))
    cluster = materialize(both.select("l.v", "l.u").distinct(), "clusters")
    state = None
    while True:
        now = cluster.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            break
        state = now
        least = materialize(cluster.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), "least")
        hot = least.where(F.col("n") > max(1000.0, hot_share * now[0])).select("v", "m").collect()  # at most 1 / hot_share rows
        cold = least.select("v", "m")
        if hot:
            few = cluster.sparkSession.createDataFrame(hot, "v string, m string")
            met = cluster.join(F.broadcast(few), "v").unionByName(cluster.join(F.broadcast(few), "v", "left_anti").join(cold, "v"))
        else:
            met = cluster.join(cold, "v")
        sent = met.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("u").alias("u")))).alias("l"))
        cluster = materialize(sent.select("l.v", "l.u").distinct(), "clusters")
        if rounds is not None:
            rounds.append(now[0])
    return cluster.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def key_components(records: DataFrame, record_id: str, keys: Column, spelling: Column | None = None) -> DataFrame:
    """``key, component`` of every key."""
    of = components(materialize(links_of(records, record_id, keys, spelling), "links"))
    return of.where(F.col("node").startswith("key:")).select(F.expr("substring(node, 5)").alias("key"), "component")


def with_components(records: DataFrame, record_id: str, keys: Column, spelling: Column | None = None) -> DataFrame:
    """``record_id, component``: one row per record."""
    kept = materialize(_keyed(records, record_id, keys, spelling).distinct(), "record-keys")
    of = components(materialize(links_of(kept, "record_id", F.col("keys"), F.col("spelling")), "links"))
    # the spelling was hashed once above and again for the links
    spelled = of.where(F.col("node").startswith("spelling:")).select(F.expr("substring(node, 10)").alias("s"), "component")
    known = kept.select("record_id", F.when(F.size("keys") > 0, F.md5("spelling")).alias("s")).join(spelled, "s", "left")
    return known.groupBy("record_id").agg(F.min("component").alias("component")).select("record_id", F.coalesce("component", F.concat(F.lit("record:"), "record_id")).alias("component"))


def _split(component: Column, weights: dict[str, Column], seed: Column) -> Column:
    """The split of highest rendezvous score ``weight / -ln(unit hash)``; 40 bits of a digest for each split."""
    scores = []
    for i, (name, weight) in enumerate(sorted(weights.items())):
        digest = F.md5(F.concat_ws("|", component, seed.cast("string"), F.lit(str(i // 3))))
        unit = (F.conv(F.substring(digest, 1 + 10 * (i % 3), 10), 16, 10).cast("long") + 0.5) / float(1 << 40)
        scores.append(F.struct((weight / -F.log(unit)).alias("score"), F.lit(name).alias("name")))
    return scores[0]["name"] if len(scores) == 1 else F.greatest(*scores)["name"]


def calibrate(sizes: DataFrame, shares: dict[str, float], seeds: int = SEEDS, corrections: int = CORRECTIONS) -> tuple[int, dict[str, float]]:
    """Salt and weights whose largest gap between given and wanted shares is least; ``sizes(component, n)``.

    One row per salt comes to the driver in each pass.
    """
    names = sorted(shares)
    want = {s: shares[s] / sum(shares.values()) for s in names}
    weights = {seed: dict(want) for seed in range(1, seeds + 1)}
    best: tuple = (2.0, 0, 1, want)
    sizes = materialize(sizes, "component-sizes")
    for turn in range(corrections + 1):
        table = sizes.sparkSession.createDataFrame([(k, *(w[s] for s in names)) for k, w in weights.items()], f"seed int, {', '.join(f'w{i} double' for i in range(len(names)))}")
        tried = sizes.select("n", "component", F.explode(F.sequence(F.lit(1), F.lit(seeds))).alias("seed")).join(F.broadcast(table), "seed")
        placed = tried.select("seed", "n", _split(F.col("component"), {s: F.col(f"w{i}") for i, s in enumerate(names)}, F.col("seed")).alias("split"))
        for r in placed.groupBy("seed").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"s{i}") for i, s in enumerate(names)]).collect():
            got = {s: r[f"s{i}"] / r["n"] for i, s in enumerate(names)}
            best = min(best, (round(max(abs(got[s] - want[s]) for s in names), 12), turn, r["seed"], dict(weights[r["seed"]])), key=lambda b: b[:3])
            for s in names:
                weights[r["seed"]][s] *= min(4.0, max(0.25, want[s] / got[s])) if got[s] else 4.0
    return best[2], best[3]


def assign(linked: DataFrame, shares: dict[str, float], seeds: int = SEEDS, corrections: int = CORRECTIONS) -> DataFrame:
    """``record_id, component, new_split`` from :func:`with_components`."""
    shares = {s: w for s, w in shares.items() if w > 0}
    member = materialize(linked.select("record_id", "component"), "members")
    seed, weights = calibrate(member.groupBy("component").agg(F.count("*").alias("n")), shares, seeds, corrections)
    return member.select("record_id", "component", _split(F.col("component"), {s: F.lit(w) for s, w in weights.items()}, F.lit(seed)).alias("new_split"))
