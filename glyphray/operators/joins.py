"""Joins between configuration, nodes, containers and lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphray.functions.text import strip
from glyphray.operators.chain import split_names


def _pieces(text: Column, size: Column) -> Column:
    """Hashes of all pieces of ``text`` of one size, each once."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(size, F.substring(text, i, size))))


def _contained(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """The names that some text contains.

    Names and texts are cut into pieces of 1, 2, 4, ... characters: of a name those of the largest such size that it has,
    which are over half of it, of a text those of all sizes that names need. A name meets the texts that have its rarest
    piece, and only these pairs are compared. Work is linear in the length of texts, for each of the few sizes; what is
    shuffled for a piece is two numbers.
    """
    given = names.filter(F.length(name) > 0).distinct()
    sized = given.withColumn("__size", F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.length(name))) - 1))
    sizes = sized.agg(F.collect_set("__size").alias("__sizes"))  # at most one for each bit of a length
    wanted = sized.select(name, F.explode(_pieces(F.col(name), F.col("__size"))).alias("__piece"))
    whole = texts.filter(F.col(text).isNotNull()).distinct().withColumn("__text", F.xxhash64(text))
    fitting = whole.join(F.broadcast(sizes), F.lit(True)).withColumn("__size", F.explode("__sizes"))
    have = fitting.filter(F.col("__size") <= F.length(text)).select(
        "__text", F.explode(_pieces(F.col(text), F.col("__size"))).alias("__piece"))
    counts = have.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    rarest = F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__piece").alias("piece")))
    anchors = wanted.join(counts, "__piece", "left").groupBy(name).agg(rarest.alias("__rarest")).filter("__rarest.n > 0")
    pairs = anchors.select(name, F.col("__rarest.piece").alias("__piece")).join(have, "__piece").select(name, "__text")
    return pairs.join(whole, "__text").filter(F.contains(text, name)).select(name)


def stream_status(streams: DataFrame, containers: DataFrame, name: str = "stream",
                  container: str = "container", exact: bool = False) -> DataFrame:
    """Streams with ``status``: Running when any container text contains the stream name.

    A name that is empty or null is in no text. ``exact`` compares whole names.
    """
    if exact:
        found = containers.select(F.regexp_replace(container, ":.*$", "").alias(name))
    else:
        found = _contained(streams.select(name), containers.select(container), name, container)
    hits = found.distinct().withColumn("__hit", F.lit(True))
    joined = streams.join(hits, name, "left")
    return joined.withColumn("status", F.when(F.col("__hit"), "Running").otherwise("Stopped")).drop("__hit")


def with_alive(nodes: DataFrame, live_pids: DataFrame, pid: str = "pid") -> DataFrame:
    """Adds ``alive``. Nodes without pid get distinct stand-in keys below zero, so they spread."""
    spread = F.coalesce(F.col(pid), -1 - F.pmod(F.xxhash64(*nodes.columns), F.lit(1 << 20)))
    live = live_pids.select(F.col(pid).cast("bigint").alias("__pid")).filter("__pid >= 0").distinct()
    joined = nodes.withColumn("__pid", spread.cast("bigint")).join(
        live.withColumn("__alive", F.lit(True)), "__pid", "left"
    )
    return joined.withColumn("alive", F.coalesce("__alive", F.lit(False))).drop("__pid", "__alive")


def node_liveness(nodes: DataFrame, live_pids: DataFrame, pid: str = "pid") -> DataFrame:
    """Nodes with ``alive`` and the status that follows from it."""
    return with_alive(nodes, live_pids, pid).withColumn(
        "status", F.when(F.col("alive"), "running").otherwise("stopped")
    )


def startable_nodes(nodes: DataFrame, live_pids: DataFrame, pid: str = "pid") -> DataFrame:
    """Nodes listed as stopped whose pid is missing or dead."""
    return with_alive(nodes.filter(F.col("status") == "stopped"), live_pids, pid).filter("not alive").drop("alive")


def resolve_modules(configs: DataFrame, available: DataFrame, enabled: str = "enabled") -> DataFrame:
    """One row per configured module name in order: ``loaded``, ``disabled`` or ``missing``.

    ``available``: ``module, is_enabled``, one row per module.
    """
    wanted = configs.withColumn("__names", split_names(F.col(enabled))).select(
        *[c for c in configs.columns if c != enabled], F.posexplode("__names").alias("pos", "module")
    )
    joined = wanted.join(available, "module", "left")
    status = F.when(F.col("is_enabled").isNull(), "missing").when(F.col("is_enabled"), "loaded").otherwise("disabled")
    return joined.withColumn("status", status).drop("is_enabled")


def with_state(candidates: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates with ``state``: ``new`` or ``duplicate``, in one join."""
    seen = known.select(*keys).distinct().withColumn("__seen", F.lit(True))
    state = F.when(F.col("__seen"), "duplicate").otherwise("new")
    return candidates.join(seen, list(keys), "left").withColumn("state", state).drop("__seen")


def complete_configs(candidates: DataFrame, known: DataFrame, name: str = "stream",
                     fields: Sequence[str] = ("input_map", "docker_script", "docker_map", "config_file")) -> DataFrame:
    """Stream configurations that may be saved: named, all fields filled, name not taken."""
    ok = strip(F.col(name)) != ""
    for f in fields:
        ok = ok & (F.col(f) != "")
    named = candidates.filter(ok).withColumn(name, strip(F.col(name)))
    return named.join(known.select(name), name, "left_anti")


def join_lineage(headers: DataFrame, slices: DataFrame, crops: DataFrame, texts: DataFrame,
                 uid: str = "uid") -> DataFrame:
    """Header, slice, crop and text rows of one instance on their shared identifiers.

    The longest keys are joined first: crops and texts that were grouped by them need no further shuffle, and rows go from
    one key to the next once each.
    """
    cut, region = [uid, "slice_no"], [uid, "slice_no", "label"]
    rest = [c for df, keys in ((headers, [uid]), (slices, cut), (crops, region), (texts, region))
            for c in df.columns if c not in keys]
    joined = crops.join(texts, region, "left").join(slices, cut).join(headers, uid)
    return joined.select(*region, *rest)
