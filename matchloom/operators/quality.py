"""Catalogue validation, quality assessment, sampling and state projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normalised screen regions (name, x, y, width, height).
REGIONS = [
    ("minimap", 0.000, 0.000, 0.257, 0.343),
    ("round_info", 0.455, 0.003, 0.090, 0.090),
    ("kill_feed", 0.785, 0.003, 0.212, 0.250),
    ("crosshair", 0.480, 0.470, 0.040, 0.060),
    ("money", 0.000, 0.861, 0.137, 0.139),
    ("player_status", 0.250, 0.792, 0.500, 0.208),
    ("weapon_utility", 0.859, 0.573, 0.141, 0.427),
]
ACCEPTED = (".mp4", ".mov", ".mkv")


def flags(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def with_duration(catalogue: DataFrame) -> DataFrame:
    """Duration is frames / fps, NULL unless fps is positive."""
    return catalogue.withColumn("duration_sec", F.when(F.col("fps") > 0, F.col("frames") / F.col("fps")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def validate(catalogue: DataFrame) -> DataFrame:
    """Errors block a recording, warnings do not."""
    unknown = F.col("width").isNull() | F.col("height").isNull()
    errors = flags(
        (~F.coalesce("present", F.lit(False)), "missing_file"), (~suffix(F.col("path")).isin(*ACCEPTED), "bad_extension"),
        (unknown, "unknown_resolution"), (F.col("fps").isNull(), "unknown_fps"))
    warnings = flags(
        (~unknown & ((F.col("width") < 640) | (F.col("height") < 360)), "low_resolution"),
        (F.col("fps") < 1.0, "low_fps"), (F.col("fps") > 240, "high_fps"))
    return catalogue.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("is_valid", F.size("errors") == 0)


def assess(catalogue: DataFrame, width: int = 1920, height: int = 1080, fps: float = 60.0) -> DataFrame:
    """Match against the target resolution, aspect ratio and frame rate."""
    known = F.col("width").isNotNull() & F.col("height").isNotNull()
    near = (F.abs(F.col("width") - width) <= 4) & (F.abs(F.col("height") - height) <= 4)
    measurable = known & (F.col("height") != 0)
    ratio, target = F.col("width") / F.nullif(F.col("height"), F.lit(0)), width / height
    resolution = F.when(known, near).otherwise(False)
    aspect = F.when(measurable, F.abs(ratio - target) <= 0.02).otherwise(True)
    rate = F.coalesce(F.abs(F.col("fps") - fps) <= 0.5, F.lit(False))
    return catalogue.select(
        "*", resolution.alias("resolution_match"), aspect.alias("aspect_match"), rate.alias("fps_match"),
        F.coalesce(ratio > target + 0.02, F.lit(False)).alias("letterbox"),
        F.coalesce(ratio < target - 0.02, F.lit(False)).alias("pillarbox"),
        flags((~known, "unknown_resolution"), (known & ~near, "resolution"), (~aspect, "aspect"),
              (F.col("fps").isNull(), "unknown_fps"), (F.col("fps").isNotNull() & ~rate, "fps")).alias("quality_warnings"))


def sampling_step(native: Column, sample: float) -> Column:
    """``max(1, round half-even(native / sample))`` for a positive native rate."""
    return F.when(native > 0, F.greatest(F.lit(1), F.bround(native / F.lit(float(sample))).cast("int")))


def ingestion_report(catalogue: DataFrame, sample_fps: float = 2.0) -> DataFrame:
    """Validation and quality joined into a readiness row with its sampling plan."""
    r = assess(validate(with_duration(catalogue)))
    step = sampling_step(F.col("fps"), sample_fps)
    frames = F.when(F.col("duration_sec") > 0, F.floor(F.col("fps") * F.col("duration_sec") / step)).cast("long")
    acceptable = F.col("resolution_match") | (F.col("width").isNotNull() & F.col("height").isNotNull())
    r = r.withColumn("step", step).withColumn("estimated_frames", frames).withColumn("is_ready", F.col("is_valid") & acceptable)
    reasons = F.concat("errors", "warnings")
    trouble = F.concat(F.lit("Video requires attention: "), F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(
        "Quality assessment indicates issues."))
    estimate = F.when(F.col("estimated_frames").isNotNull(),
                      F.concat(F.lit("Estimated "), F.col("estimated_frames").cast("string"), F.lit(f" frames at {sample_fps} fps.")))
    return r.withColumn("summary", F.concat_ws(" ", F.when(F.col("is_ready"), "Video passed ingestion checks.").otherwise(trouble), estimate))


def stride_sample(frames: DataFrame, index: str, step: Column, fps: Column) -> DataFrame:
    """Every ``step``-th frame with its timestamp."""
    return frames.filter(F.pmod(F.col(index), step) == 0).withColumn("timestamp_sec", F.col(index) / fps)


def region_boxes(screens: DataFrame, width: str, height: str) -> DataFrame:
    """Clamped pixel rectangle of every region on every screen (seven fixed regions per row)."""
    regions = F.array(*[F.struct(F.lit(n).alias("region"), F.lit(x).alias("nx"), F.lit(y).alias("ny"),
                                 F.lit(w).alias("nw"), F.lit(h).alias("nh")) for n, x, y, w, h in REGIONS])
    rows = screens.withColumn("_r", F.explode(regions))
    whole = lambda norm, size: F.floor(F.col(f"_r.{norm}") * F.col(size)).cast("int")
    zero, one = F.lit(0), F.lit(1)
    x = F.greatest(zero, F.least(whole("nx", width), F.col(width) - 1))
    y = F.greatest(zero, F.least(whole("ny", height), F.col(height) - 1))
    w = F.greatest(one, F.least(F.greatest(one, whole("nw", width)), F.col(width) - x))
    h = F.greatest(one, F.least(F.greatest(one, whole("nh", height)), F.col(height) - y))
    return rows.select(*screens.columns, "_r.region", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def namespaced_state(df: DataFrame, regions: dict[str, Column], out: str = "values") -> DataFrame:
    """Region maps merged under ``region.key`` with a confidence by key count."""
    def prefixed(name: str, values: Column) -> Column:
        return F.transform_keys(values, lambda k, _: F.concat(F.lit(name + "."), k))

    merged = F.map_concat(*[prefixed(n, m) for n, m in regions.items()])
    n = F.size(F.map_keys(F.col(out)))
    return df.withColumn(out, merged).withColumn(
        "confidence", F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.lit(0.5) + n * 0.1)))


def signal_flags(df: DataFrame) -> DataFrame:
    """Boolean signals from per-frame numeric statistics."""
    flashed = (F.col("mean") > 205) & (F.col("std") < 65)
    return df.select(
        "*", flashed.alias("flashed"), ((F.col("dark") > .72) & (F.col("mean") < 105)).alias("scoped"),
        (~flashed & (F.col("shot_score") >= .04)).alias("shot_candidate"),
        (~flashed & (F.col("damage_score") >= .025)).alias("damage_candidate"),
        ((F.col("kill_score") >= .45) | (F.col("kill_rows") > 0)).alias("kill_highlight"),
        (F.col("timer_ratio") > .008).alias("timer_active"), (F.col("feed_fraction") > .005).alias("kill_feed_active"))


def hud_state(df: DataFrame) -> DataFrame:
    """Status values from pixel counts."""
    coloured = F.col("green") + F.col("red")
    present = (F.col("white") > 20) | (coloured > 30)
    fill = F.least(F.lit(100), F.greatest(F.lit(1), F.bround(coloured / F.greatest(F.col("bar_pixels"), F.lit(1)) * 100).cast("int")))
    return df.select(
        "*", F.when(~present, 0).when(coloured > 0, fill).otherwise(50).alias("hp"),
        (present & (coloured > 0) & (F.col("red") > F.col("green"))).alias("hp_low"),
        ((F.col("blue") > 15) | (F.col("armour_white") > 20)).alias("armour"), (F.col("yellow") > 20).alias("ammo_visible"),
        (F.col("ct_px") > 8).alias("ct_score_present"), (F.col("t_px") > 8).alias("t_score_present"),
        (F.greatest(F.lit(0), F.col("bright") - F.col("feed_green")) / F.greatest(F.col("total"), F.lit(1))).alias("feed_fraction"))


def state_bands(df: DataFrame, hp: str = "hp", armour: str = "armour_value") -> DataFrame:
    """Health banding, armour tip, status text and confidence."""
    health = F.coalesce(F.col(hp), F.lit(100))
    band = F.when(health < 20, "critical").when(health < 50, "low").when(health < 80, "moderate").otherwise("healthy")
    phase = F.when(F.coalesce("round_active", F.lit(True)), "round active").otherwise("round inactive")
    parts = F.array_compact(F.array(F.concat(F.lit("hp "), band), phase))
    actions = flags((health < 20, "avoid contact"), ((health >= 20) & (health < 50), "play safe"),
                    (~F.coalesce("round_active", F.lit(True)), "plan the round"),
                    (F.coalesce("kill_feed_active", F.lit(False)) & (health < 50), "stay cautious"))
    return df.select(
        "*", band.alias("band"), F.coalesce((F.col(armour) < 60) & (health > 50), F.lit(False)).alias("armour_tip"),
        F.array_join(parts, " | ").alias("status"),
        F.when(F.size(actions) > 0, F.array_join(actions, " | ")).otherwise("context required").alias("next_action"),
        F.when(F.size(parts) >= 2, .7).otherwise(.5).alias("advice_confidence"))


def held_item(df: DataFrame, vocabulary: tuple[str, ...], minimum: float, direct: bool = True) -> DataFrame:
    """Primary held item by precedence; an agreeing hint raises its confidence and joins the sources.

    Columns: scoped, c4, item, item_conf, item_source, hint, hint_conf, hint_source.
    """
    model = F.col("item").isin(*vocabulary) & (F.col("item_conf") >= minimum)
    def first(scope, c4, other):
        base = F.when(F.col("scoped"), scope).when(F.col("c4"), c4) if direct else None
        return base.when(model, other) if direct else F.when(model, other)
    kind = first(F.lit("sniper"), F.lit("c4"), F.col("item"))
    conf = first(F.lit(.97), F.lit(.96), F.col("item_conf"))
    src = first(F.lit("native_scope_view"), F.lit("held_c4_geometry"), F.col("item_source"))
    agree = F.coalesce((F.col("hint") == kind) & F.col("hint").isin(*vocabulary), F.lit(False))
    return df.select(
        "*", kind.alias("held"),
        F.when(agree, F.least(F.lit(1.0), F.greatest(conf, F.col("hint_conf")) + .02)).otherwise(conf).alias("held_confidence"),
        F.when(agree, F.concat_ws("+", src, F.col("hint_source"))).otherwise(src).alias("held_source"))


def admissible(df: DataFrame) -> DataFrame:
    """Observations above their kind's floor; money and position also need an active first-person view."""
    view = F.col("first_person_active") & F.col("timer_visible")
    rule = (F.when(F.col("kind") == "clock", F.col("confidence") >= .35)
            .when(F.col("kind") == "money", (F.col("confidence") >= .55) & F.col("value_num").between(0, 16000) & view)
            .when(F.col("kind") == "weapon", F.col("confidence") >= .80)
            .when(F.col("kind") == "utility", F.col("confidence") >= .85)
            .when(F.col("kind") == "position",
                  (F.col("confidence") >= .30) & (F.length(F.regexp_replace("value_str", r"[^\p{L}]", "")) >= 3) & view))
    return df.filter(F.coalesce(rule, F.lit(False)))


def state_profile(df: DataFrame, flags_: list[str], numbers: list[str]) -> DataFrame:
    """Per boolean key its count and share of frames; per numeric key min, max and mean.

    All keys are aggregated in one pass and turned into rows afterwards.
    """
    aggs = [F.count(F.lit(1)).alias("_total")]
    aggs += [F.count_if(F.col(f)).alias(f"c_{f}") for f in flags_]
    for n in numbers:
        aggs += [F.min(n).cast("double").alias(f"lo_{n}"), F.max(n).cast("double").alias(f"hi_{n}"), F.avg(n).alias(f"av_{n}")]
    one = df.agg(*aggs)
    nul = F.lit(None).cast("double")
    rows = [F.struct(F.lit(f).alias("key"), F.col(f"c_{f}").alias("n"), F.bround(F.col(f"c_{f}") * 100 / F.greatest(F.col("_total"), F.lit(1))).cast("double").alias("pct"),
                     nul.alias("low"), nul.alias("high"), nul.alias("mean")) for f in flags_]
    rows += [F.struct(F.lit(n).alias("key"), F.lit(None).cast("long").alias("n"), nul.alias("pct"), F.col(f"lo_{n}").alias("low"),
                      F.col(f"hi_{n}").alias("high"), F.round(f"av_{n}", 4).alias("mean")) for n in numbers]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
