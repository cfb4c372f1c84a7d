"""Engagements, native kills and native deaths as DataFrame compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.operators.blocks import durable, run_blocks
from matchloom.operators.intervals import interval_join
from matchloom.operators.kernels import OrphanEpisodes, RowTracks
from matchloom.operators.scan import block_of, islands, scan
from matchloom.operators.selection import medians
from matchloom.operators.sessions import gap_islands

ROUND = ["video_id", "rid"]


def first_round(points: DataFrame, rounds: DataFrame, at: str, width: float) -> DataFrame:
    """The first listed round holding the point; open rounds hold everything after their start.

    Closed rounds hold a point at most a few times; of the open ones only the
    earliest of the recording can come first, so no point meets every open round.
    """
    closed = rounds.filter("e IS NOT NULL").select("video_id", "s", "e", F.col("rid").alias("_rid"))
    hit = interval_join(points, closed, ["video_id"], at, "s", "e", width)
    hit = hit.select(*points.columns, "_rid")
    first_open = rounds.filter("e IS NULL").groupBy("video_id").agg(
        F.min_by("s", "rid").alias("_os"), F.min("rid").alias("_orid"))
    opened = points.join(first_open, "video_id").filter(F.col(at) >= F.col("_os")).select(
        *points.columns, F.col("_orid").alias("_rid"))
    return hit.unionByName(opened).groupBy(*points.columns).agg(F.min("_rid").alias("rid"))


def engagement_episodes(
    rounds: DataFrame, detections: DataFrame, signals: DataFrame, width: int, gap, margin, top: int = 4,
) -> DataFrame:
    """Opposing-side sightings grouped into episodes and joined with nearby combat signals.

    ``detections`` holds video_id, seq, t, own_team, label, conf (one row per box);
    ``signals`` holds video_id, seq, t, shot, damage, signal_score.
    """
    block = block_of("t", width)
    enemy = detections.filter(F.col("own_team").isin("t", "ct") & F.col("label").isin("t", "ct")
                              & (F.col("label") != F.col("own_team")))
    enemy = enemy.groupBy("video_id", "seq", "t").agg(
        F.max_by(F.struct("own_team", "label", "conf"), F.col("conf")).alias("d")).select(
        "video_id", "seq", "t", "d.*")
    closed = rounds.filter("e IS NOT NULL").select("video_id", "rid", "s", "e")
    seen = interval_join(enemy, closed, ["video_id"], "t", "s", "e", width)
    episodes = gap_islands(seen, ROUND, ["t", "seq"], block, "t", gap).filter(F.col("episode") <= top)
    best = F.min_by(F.struct("t", "seq", "conf", "label"), F.struct(-F.col("conf"), F.col("t"), F.col("seq")))
    episodes = episodes.groupBy(*ROUND, "episode").agg(
        F.min("s").alias("s"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min_by("own_team", F.struct("t", "seq")).alias("player_team"), best.alias("best"),
        F.count(F.lit(1)).alias("visible_samples"))
    episodes = durable(episodes)
    bands = episodes.select(*ROUND, "episode", (F.col("first_t") - margin).alias("lo"), (F.col("last_t") + margin).alias("hi"))
    active = signals.filter("shot OR damage")
    near = interval_join(active, bands, ["video_id"], "t", "lo", "hi", width, "both")
    strongest = F.min_by(F.struct("t", "seq"), F.struct(
        -F.col("signal_score"), (~F.col("shot")).cast("int"), F.col("t"), F.col("seq")))
    near = near.groupBy(*ROUND, "episode").agg(
        F.count_if("shot").alias("shots"), F.count_if("damage").alias("damages"),
        F.min(F.when(F.col("shot"), F.col("t"))).alias("first_shot"),
        F.min(F.when(F.col("damage"), F.col("t"))).alias("first_damage"), strongest.alias("signal"))
    out = episodes.join(near, [*ROUND, "episode"], "left")
    return out.select(
        *ROUND, "episode", "s", "first_t", "last_t", "player_team",
        F.col("best.label").alias("enemy_team"), F.col("best.conf").alias("max_confidence"), "visible_samples",
        F.when(F.col("signal").isNotNull(), "likely_firefight").otherwise("visual_contact").alias("engagement_level"),
        F.coalesce("shots", F.lit(0)).alias("shots"), F.coalesce("damages", F.lit(0)).alias("damages"),
        "first_shot", "first_damage", (F.col("first_shot") - F.col("first_t")).alias("first_shot_offset"),
        F.coalesce("signal.t", "best.t").alias("clip_trigger"),
        F.least(F.lit(.92), F.lit(.58) + F.col("best.conf") * .4).alias("confidence"))


def episode_row_limits(samples: DataFrame, episode_key: list[str], order: list[str], block: Column) -> DataFrame:
    """Peak simultaneous rows against one plus the counted downward insertions."""
    s = samples.withColumn("_n", F.size("prints")).withColumn(
        "_single", F.when((F.size("prints") == 1) & (F.size("positions") > 0), F.col("positions")[0]))
    s = scan(s, episode_key, order, block, prev={"_prior": F.col("_n")}, last={"_anchor": F.col("_single")})
    prior = F.coalesce("_prior", F.lit(0))
    grows = ((F.col("_n") > prior) & (F.col("_n") >= 2) & F.col("_anchor").isNotNull()
             & (F.array_max("positions") - F.col("_anchor") >= .07))
    return s.groupBy(*episode_key).agg(F.greatest(
        F.lit(1), F.max("_n"),
        1 + F.sum(F.when(grows, F.col("_n") - F.greatest(F.lit(1), prior)).otherwise(0))).cast("int").alias("row_limit"))


def follow_rows(fed: DataFrame, width: int, retention) -> DataFrame:
    """Rows of ``RowTracks`` for rows with content (video_id, seq, t, prints, episode, row_limit).

    A new episode after a silence longer than the retention finds no live track, so a
    stretch between two such silences depends on nothing before it. A block begins with
    a stretch and holds what starts within it; only a stretch longer than a block is cut.
    """
    key, order, block = ["video_id"], ["t", "seq"], block_of("t", width)
    near = scan(fed, key, order, block, prev={"_t": F.col("t"), "_e": F.col("episode")})
    anew = F.col("_t").isNull() | ((F.col("t") - F.col("_t") > retention) & (F.col("episode") != F.col("_e")))
    near = durable(near.withColumn("anew", anew).drop("_t", "_e"))
    start = F.when(F.col("anew"), F.col("t"))
    near = scan(near, key, order, block, last={"_s": start}).withColumn("_s", F.coalesce(start, "_s"))
    began, now = block_of("_s", width), block_of("t", width)
    cut = near.withColumn("stretch", F.when(now - began <= 1, began).otherwise(now)).drop("_s")
    return run_blocks(cut.select(*fed.columns, "anew", "stretch"), key, order, F.col("stretch"), RowTracks(retention), "anew")


def feed_row_tracks(samples: DataFrame, width: int, gap, retention) -> DataFrame:
    """Unique highlighted feed rows: video_id, track_seq, track_no, seq, t, frame_score.

    ``samples`` holds video_id, seq, t, highlight_score, prints, positions.
    """
    key, order, block = ["video_id"], ["t", "seq"], block_of("t", width)
    episodes = durable(gap_islands(samples, key, order, block, "t", gap))
    limits = episode_row_limits(episodes, [*key, "episode"], order, block)
    rows = episodes.join(limits, [*key, "episode"])
    fed = rows.filter(F.size("prints") > 0).select("video_id", "seq", "t", "prints", "episode", "row_limit")
    assigned = follow_rows(fed, width, retention)
    spans = assigned.groupBy("video_id", "track_seq", "track_no").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    bare = episodes.groupBy("video_id", "episode").agg(
        F.max(F.size("prints")).alias("_n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.min_by("seq", F.struct("t", "seq")).alias("track_seq")).filter("_n = 0")
    line = spans.select("video_id", "track_seq", "track_no", "first_t", "last_t",
                        F.lit(False).alias("orphan"), (F.col("first_t") - retention).cast("long").alias("at"))
    line = line.unionByName(bare.select("video_id", "track_seq", F.lit(-1).alias("track_no"), "first_t", "last_t",
                                        F.lit(True).alias("orphan"), F.col("last_t").alias("at")))
    attached = run_blocks(line, key, ["at", "orphan", "track_seq", "track_no"], block_of("at", width),
                          OrphanEpisodes(retention))
    orphans = episodes.join(
        bare.select("video_id", "episode", F.col("track_seq").alias("orphan_seq")), ["video_id", "episode"])
    orphans = orphans.join(attached, ["video_id", "orphan_seq"]).select("video_id", "track_seq", "track_no", "seq", "t")
    members = assigned.select("video_id", "track_seq", "track_no", "seq", "t").unionByName(orphans).distinct()
    # from the written episodes: the samples would be derived once more
    return members.join(episodes.select("video_id", "seq", "highlight_score"), ["video_id", "seq"])


def native_kills(
    rounds: DataFrame, samples: DataFrame, firefights: DataFrame, width: int, unit: float,
    minimum_samples: int = 2, single_score: float = .97,
) -> DataFrame:
    """Count content-tracked rows as kills and corroborate them with engagements.

    ``firefights`` holds video_id, rid, episode, first_shot, last_t.
    """
    tracks = feed_row_tracks(samples, width, 2.1 * unit, 5.5 * unit)
    kills = tracks.groupBy("video_id", "track_seq", "track_no").agg(
        F.min("t").alias("t"), F.max("t").alias("until"), F.max("highlight_score").alias("score"),
        F.count_distinct("seq").alias("observations"))
    placed = durable(first_round(durable(kills), durable(rounds), "t", width))
    fights = firefights.filter("first_shot IS NOT NULL").select(
        "video_id", "rid", "episode", "first_shot", (F.col("first_shot") - .75 * unit).alias("lo"),
        F.greatest(F.col("last_t") + 3.0 * unit, F.col("first_shot") + 3.5 * unit).alias("hi"))
    near = interval_join(placed, fights, ROUND, "t", "lo", "hi", width, "both")
    near = near.groupBy(*ROUND, "track_seq", "track_no").agg(F.min_by(
        "episode", F.struct(F.abs(F.col("t") - F.col("first_shot")), F.col("episode"))).alias("engagement"))
    out = placed.join(near, [*ROUND, "track_seq", "track_no"], "left")
    known = F.col("engagement").isNotNull()
    out = out.filter(~((F.col("observations") < minimum_samples) & ~known & (F.col("score") < single_score)))
    base = F.least(F.lit(.94), F.lit(.80) + F.col("score") * .12)
    return out.withColumn("confidence", F.when(known, F.least(F.lit(.96), base + .04)).otherwise(base))


def _missing_runs(current: DataFrame, state: Column, block: Column, order: list[str]) -> DataFrame:
    """Runs of ``state = false`` with the length of the run and its first sample."""
    marked = current.withColumn("_state", state)
    runs = islands(marked, ROUND, order, block, {"v": F.coalesce("_state", F.lit(True)) & F.lit(True)},
                   lambda p, c: p["v"] != c["v"], "run")
    head = F.min_by(F.struct("seq", "t", "s", "step", "flash_before", "damage_near"), F.struct(*order))
    return runs.filter("_state = false").groupBy(*ROUND, "run").agg(
        head.alias("h"), F.max("t").alias("last_t")).select(
        *ROUND, "run", "h.*", (F.col("last_t") - F.col("h.t") + F.col("h.step")).alias("missing"))


def native_deaths(
    rounds: DataFrame, samples: DataFrame, width: int, unit: float,
    min_missing: float = .75, max_missing: float = 5.0, min_prior: float = 1.0,
    min_coverage: float = .35, min_eligible: float = .6,
) -> DataFrame:
    """At most one death per closed round from a supported disappearance.

    ``samples`` holds video_id, seq, t, flashed, health, damage, left_alive,
    right_alive, left_score, right_score.
    """
    order, block = ["t", "seq"], block_of("t", width)
    u = float(unit)
    all_seen = scan(samples, ["video_id"], order, block, last={"flash_before": F.when(F.col("flashed"), F.col("t"))})
    closed = rounds.filter("e IS NOT NULL").select("video_id", "rid", "s", "e")
    current = interval_join(all_seen.filter("NOT flashed"), closed, ["video_id"], "t", "s", "e", width)
    hit = F.when(F.col("damage"), F.col("t"))
    current = scan(current, ROUND, order, block, prev={"_pt": F.col("t")}, last={"_dmg_before": hit}, ahead={"_dmg_after": hit})
    gap = F.col("t") - F.col("_pt")
    current = durable(current)
    middle = medians(current, ROUND, {
        "step": F.when(gap > 0, gap), "left_med": F.when(F.col("left_alive").isNotNull(), F.col("left_score")),
        "right_med": F.when(F.col("right_alive").isNotNull(), F.col("right_score"))})
    stats = current.groupBy(*ROUND).agg(F.count(F.lit(1)).alias("n"), F.count_if("health").alias("visible"))
    stats = stats.filter("n >= 4 AND visible >= 2").join(middle, ROUND).select(
        *ROUND, F.coalesce("step", F.lit(.5 * u)).alias("step"), F.coalesce("left_med", F.lit(0.0)).alias("left_med"),
        F.coalesce("right_med", F.lit(0.0)).alias("right_med"))
    stats = durable(stats)
    current = current.join(stats, ROUND).withColumn(
        "damage_near", F.coalesce(F.col("damage"), F.lit(False))
        | F.coalesce(F.col("t") - F.col("_dmg_before") <= 2 * u, F.lit(False))
        | F.coalesce(F.col("_dmg_after") - F.col("t") <= 2 * u, F.lit(False)))

    def candidates(rows: DataFrame, state: Column, method: str) -> DataFrame:
        runs = _missing_runs(rows, state, block, order)
        flash = F.coalesce(F.col("t") - F.col("flash_before") <= 4 * u, F.lit(False))
        bridge = flash if method == "health" else F.lit(False)
        look = F.greatest(F.when(bridge, 4 * u).otherwise(2 * u), F.lit(min_prior * u) + F.col("step"))
        runs = runs.withColumn("flash_bridge", bridge).withColumn("lo", F.col("t") - look).withColumnRenamed("t", "hi")
        seen = rows.withColumn("_state", state).filter("_state").select(*ROUND, F.col("t").alias("at"))
        prior = interval_join(seen, runs.select(*ROUND, "run", "lo", "hi"), ROUND, "at", "lo", "hi", width)
        prior = prior.groupBy(*ROUND, "run").agg(F.count(F.lit(1)).alias("prior_n"))
        runs = runs.join(prior, [*ROUND, "run"]).withColumn("prior", F.col("prior_n") * F.col("step"))
        lasting = F.col("missing") >= min_missing * u
        if method == "health":
            lasting = lasting | ((F.col("missing") >= F.col("step")) & F.col("damage_near"))
        ok = ((F.col("hi") - F.col("s") >= 3 * u) & lasting & (F.col("missing") <= max_missing * u)
              & (F.col("prior") >= min_prior * u))
        first = F.min_by(F.struct("seq", "hi", "missing", "prior", "damage_near", "flash_bridge"), F.col("hi"))
        return runs.filter(ok).groupBy(*ROUND).agg(first.alias("d")).select(
            *ROUND, "d.seq", F.col("d.hi").alias("t"), "d.missing", "d.prior", "d.damage_near", "d.flash_bridge",
            F.lit(method).alias("method"))

    primary = durable(candidates(current, F.coalesce(F.col("health"), F.lit(False)), "health"))
    left = F.col("left_med") > F.col("right_med")
    cards = current.filter(F.greatest("left_med", "right_med") >= .12)
    card = F.when(left, F.col("left_alive")).otherwise(F.col("right_alive"))
    alive = cards.groupBy(*ROUND).agg(F.count_if(card).alias("_alive")).filter("_alive >= 2").select(*ROUND)
    cards = cards.join(alive, ROUND, "left_semi").join(primary.select(*ROUND), ROUND, "left_anti")
    fallback = candidates(cards, card, "card")
    found = primary.unionByName(fallback).withColumn(
        "confidence", F.when((F.col("method") == "card") | F.col("damage_near"), F.lit(.90)).otherwise(F.lit(.84)))

    # availability gate per recording
    cover = samples.filter("NOT flashed").groupBy("video_id").agg(
        (F.count_if("health") / F.count(F.lit(1))).alias("coverage"))
    done = closed.groupBy("video_id").agg(F.count(F.lit(1)).alias("completed"))
    eligible = stats.groupBy("video_id").agg(F.count(F.lit(1)).alias("eligible"))
    gate = cover.join(done, "video_id").join(eligible, "video_id").filter(
        (F.col("coverage") >= min_coverage) & (F.col("eligible") / F.col("completed") >= min_eligible))
    return found.join(gate.select("video_id"), "video_id", "left_semi")
