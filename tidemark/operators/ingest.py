"""From exported tables and API documents to the long store."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parse import bind, parse_date, parse_duration, parse_number
from tidemark.functions.vocab import ALIASES, CANDIDATES, CORE_METRICS, PLAUSIBLE_RANGES, TRANSFORMS, WORKOUT_ALIASES

SAMPLE = 200
WARNINGS, BAD_DATES, SAMPLES = 10, 5, 3
# Lengths that a plan's texts are cut to, its confidences, and the aggregates and precision of a new metric.
REASON_LENGTH, WARNING_LENGTH, PLAN_WARNINGS, LABEL_LENGTH, UNIT_LENGTH = 200, 220, 6, 60, 16
CONFIDENCES, AGGREGATES, MOST_PRECISE = ("high", "medium", "low"), ("mean", "sum", "last", "max", "min"), 4
NEW_KEY = r"[a-z][a-z0-9_]{1,48}"


@dataclass(frozen=True)
class NewMetric:
    """The dictionary entry of a metric that an import brings along."""

    label: str
    unit: str | None = None
    category: str = "custom"
    higher_is_better: bool | None = None
    agg: str = "mean"
    precision: int = 2


@dataclass(frozen=True)
class ColumnPlan:
    """What becomes of one column: a metric (or ``date``), a conversion and a factor."""

    header: str
    metric: str | None
    transform: str = "none"
    scale: float | None = None
    confidence: str = "high"
    reasoning: str = ""
    #: What a key that is not known yet is to be; only with it a new key is taken.
    new_metric: NewMetric | None = None


@dataclass(frozen=True)
class ImportPlan:
    kind: str = "metrics"
    columns: tuple[ColumnPlan, ...] = ()
    warnings: tuple[str, ...] = field(default_factory=tuple)


def header_key(header: str) -> str:
    return re.sub("[\"']", "", re.sub(r"[_\s]+", " ", header.lower().strip()))


def auto_map(headers: list[str], kind: str = "metrics") -> dict[str, str]:
    """Headers to keys: first by equal alias, then by alias inside the header; each is used once."""
    table, found = (WORKOUT_ALIASES if kind == "workouts" else ALIASES), {}
    for fits in (lambda h, names: header_key(h) in names, lambda h, names: any(n in header_key(h) for n in names)):
        for key, names in table.items():
            if key not in found.values():
                hit = next((h for h in headers if h not in found and fits(h, names)), None)
                if hit is not None:
                    found[hit] = key
    return found


def profile(rows: DataFrame, headers: list[str], order: str) -> DataFrame:
    """(header, filled, numeric_ratio, date_ratio, samples) over the first ``SAMPLE`` rows by ``order``.

    ``samples`` are the first three cells that are not blank.
    """
    first = rows.orderBy(order).limit(SAMPLE).select(F.col(order).alias("_order"), *[F.col(f"`{h}`").cast("string").alias(h) for h in headers])
    cells = first.unpivot(["_order"], [F.col(f"`{h}`") for h in headers], "header", "cell").where(F.trim("cell") != "")
    cell = F.col("cell")
    number = parse_number(cell).isNotNull() | parse_duration(cell).isNotNull()
    samples = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("_order", "cell"))), 1, SAMPLES), lambda s: s["cell"])
    return cells.groupBy("header").agg(
        F.count("*").alias("filled"), F.avg(number.cast("double")).alias("numeric_ratio"), F.avg(parse_date(cell).isNotNull().cast("double")).alias("date_ratio"), samples.alias("samples")
    )


def rules_plan(headers: list[str], date_ratios: dict[str, float], kind: str = "metrics") -> ImportPlan:
    """A plan from header names; without a date header, the most date-like column above one half."""
    mapped = auto_map(headers, kind)
    if "date" not in mapped.values():
        best = max(headers, key=lambda h: date_ratios.get(h, 0.0), default=None)
        if best is not None and date_ratios.get(best, 0.0) > 0.5:
            mapped[best] = "date"
    return ImportPlan(kind, tuple(ColumnPlan(h, mapped.get(h)) for h in headers))


def field_names(kind: str) -> set[str] | None:
    """The fields of sessions and sets, one column each; metrics have an open vocabulary."""
    return {"workouts": {"date", "type", "name", *WORKOUT_NUMBERS}, "sets": {"date", "session_name", "exercise", "notes", *SET_NUMBERS}}.get(kind)


def checked_metric(new: NewMetric, header: str) -> NewMetric:
    """A new metric's entry with every value in bounds."""
    label, unit = str(new.label or header)[:LABEL_LENGTH], str(new.unit)[:UNIT_LENGTH] if new.unit else None
    whole = isinstance(new.precision, (int, float)) and new.precision == new.precision
    return NewMetric(
        label, unit, new.category if new.category in {c for _, _, _, c, *_ in CORE_METRICS} else "custom", new.higher_is_better if isinstance(new.higher_is_better, bool) else None,
        new.agg if new.agg in AGGREGATES else "mean", int(min(MOST_PRECISE, max(0, new.precision))) if whole else 2,
    )


def checked_column(c: ColumnPlan, fields: set[str] | None, known: set[str], used: set[str]) -> ColumnPlan:
    """A proposed column with a key, a conversion and a factor that exist."""
    metric, new = c.metric.strip() if isinstance(c.metric, str) and c.metric != "-" else None, None
    if metric and fields is not None:
        metric = metric if metric in fields and metric not in used else None
    elif metric == "date":
        metric = None if "date" in used else metric
    elif metric and metric not in known:
        new = checked_metric(c.new_metric, c.header) if c.new_metric and re.fullmatch(NEW_KEY, metric) else None
        metric = metric if new else None
    usable = isinstance(c.scale, (int, float)) and c.scale == c.scale and abs(c.scale) not in (0.0, float("inf"))
    return replace(
        c, metric=metric or None, transform=c.transform if c.transform in TRANSFORMS else "none", scale=c.scale if usable else None,
        confidence=c.confidence if c.confidence in CONFIDENCES else "medium", reasoning=str(c.reasoning or "")[:REASON_LENGTH], new_metric=new,
    )


def sanitise(plan: ImportPlan, headers: list[str], known: set[str], date_ratios: dict[str, float]) -> ImportPlan:
    """A proposed plan as one that can be carried out: a column for each header, and a date column.

    Unknown columns, keys, conversions and factors go. Sessions and sets take each field
    once, the first column that claims it; a metric that is not known is taken only with
    a new entry and a well-formed key. Without a date column the first that is date-like
    in more than four cells of five becomes it, else the most date-like.
    """
    kind = plan.kind if plan.kind in ("workouts", "sets") else "metrics"
    proposed = {c.header: c for c in plan.columns}
    used: set[str] = set()
    columns = []
    for header in headers:
        c = checked_column(proposed[header], field_names(kind), known, used) if header in proposed else ColumnPlan(header, None, confidence="low", reasoning="not classified")
        used |= {c.metric} - {None}
        columns.append(c)
    if "date" not in used and headers:
        ratio = lambda h: date_ratios.get(h, 0.0)
        best = next((h for h in headers if ratio(h) > 0.8), max(headers, key=ratio))
        if ratio(best) > 0:
            columns = [ColumnPlan(best, "date", reasoning="the most date-like column") if c.header == best else c for c in columns]
    return ImportPlan(kind, tuple(columns), tuple(str(w)[:WARNING_LENGTH] for w in plan.warnings[:PLAN_WARNINGS]))


def cell_value(column: ColumnPlan, raw: Column, is_duration: bool = False) -> Column:
    """A cell's number (minutes first in duration columns), converted and scaled."""
    number = F.coalesce(parse_duration(raw), parse_number(raw)) if is_duration else parse_number(raw)
    return number * F.lit(TRANSFORMS[column.transform] * (column.scale or 1.0))


def is_duration(metric: str) -> bool:
    return metric.endswith(("_min", "_hours", "_h")) or metric == "duration_min"


def to_long(rows: DataFrame, plan: ImportPlan, keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide cells to (date, metric_key, value, source), one row for each cell with a date and a value."""
    date = next(c for c in plan.columns if c.metric == "date")
    metrics = [c for c in plan.columns if c.metric not in (None, "date")]
    values = F.array(*[F.struct(F.lit(c.metric).alias("metric_key"), cell_value(c, F.col(c.header).cast("string"), is_duration(c.metric)).alias("value")) for c in metrics])
    long = rows.select(*keep, parse_date(F.col(date.header).cast("string")).alias("date"), F.explode(values).alias("c"))
    return long.select(*keep, "date", "c.metric_key", "c.value", F.lit("csv").alias("source")).where("date IS NOT NULL AND value IS NOT NULL")


def bad_dates(rows: DataFrame, plan: ImportPlan, order: str) -> DataFrame:
    """(place, cell): the first five cells of the date column, by ``order``, that are no date."""
    date = next(c for c in plan.columns if c.metric == "date")
    cell = F.col(f"`{date.header}`").cast("string")
    bad = rows.where(parse_date(F.coalesce(cell, F.lit(""))).isNull()).select(F.col(order).alias("place"), F.coalesce(cell, F.lit("(empty)")).alias("cell"))
    return bad.orderBy("place").limit(BAD_DATES)


def new_definitions(plan: ImportPlan) -> list[tuple]:
    """Dictionary entries (as ``store.definitions`` has them) of the metrics that a plan brings along."""
    made = {c.metric: c.new_metric for c in plan.columns if c.metric and c.new_metric}
    return [(k, m.label, m.unit, m.category, m.higher_is_better, m.agg, m.precision, True) for k, m in made.items()]


def _fields(rows: DataFrame, plan: ImportPlan, texts: tuple[str, ...], order: str) -> DataFrame:
    """One column for each mapped field: dates parsed, ``texts`` trimmed, the rest numbers."""
    def field(c: ColumnPlan) -> Column:
        cell = F.col(c.header).cast("string")
        if c.metric == "date":
            return parse_date(cell)
        return F.nullif(F.trim(cell), F.lit("")) if c.metric in texts else cell_value(c, cell, is_duration(c.metric))

    return rows.select(order, *[field(c).alias(c.metric) for c in plan.columns if c.metric])


WORKOUT_NUMBERS = ("duration_min", "distance_km", "avg_hr", "max_hr", "calories", "elevation_m", "rpe")
SET_NUMBERS = ("set_order", "weight_kg", "reps", "rpe", "distance_km", "duration_s", "session_min")


def to_workouts(rows: DataFrame, plan: ImportPlan, order: str) -> DataFrame:
    """Session rows with a date, each with an id of its content; missing fields are null."""
    found = _fields(rows, plan, ("type", "name"), order).where("date IS NOT NULL")
    for c in ("type", "name"):
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast("string"))
    for c in WORKOUT_NUMBERS:
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast("double"))
    named = occurrence_ids(found, ["date", "type", "name", "duration_min", "distance_km"], order)
    return named.select(order, "date", "type", "name", *WORKOUT_NUMBERS, F.lit("csv").alias("source"), F.col("content_id").alias("external_id"))


def to_sets(rows: DataFrame, plan: ImportPlan, order: str) -> DataFrame:
    """Set rows with a date and an exercise, each with an id of its content; missing fields are null."""
    found = _fields(rows, plan, ("exercise", "session_name"), order)
    for c in ("exercise", "session_name"):
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast("string"))
    for c in SET_NUMBERS:
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast("double"))
    named = occurrence_ids(found.where("date IS NOT NULL AND exercise IS NOT NULL"), ["date", "session_name", "exercise", "set_order", "weight_kg", "reps"], order)
    return named.select(order, "date", "session_name", "exercise", *SET_NUMBERS, F.lit("csv").alias("source"), F.col("content_id").alias("external_id"))


def logged_values(entries: DataFrame, source: str) -> DataFrame:
    """Entries with a map of metric to typed text as long rows; what is not a number is left out."""
    long = entries.select("user_id", "date", F.explode("values").alias("metric_key", "raw"))
    number = F.regexp_extract(F.trim("raw"), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")
    return long.select("user_id", "date", "metric_key", number.alias("value"), F.lit(source).alias("source")).where("value IS NOT NULL AND abs(value) < double('infinity')")


def implausible(rows: DataFrame, plan: ImportPlan, order: str) -> DataFrame:
    """Mapped columns whose upper median over the sample is out of range, and a conversion that would bring it in."""
    columns = [c for c in plan.columns if c.metric in PLAUSIBLE_RANGES]
    first = rows.orderBy(order).limit(SAMPLE)
    cells = first.select(F.explode(F.array(*[F.struct(F.lit(c.header).alias("header"), F.lit(c.metric).alias("metric_key"), F.lit(c.transform).alias("transform"), F.coalesce(parse_number(F.col(c.header).cast("string")), parse_duration(F.col(c.header).cast("string"))).alias("raw"), F.lit(TRANSFORMS[c.transform] * (c.scale or 1.0)).alias("factor")) for c in columns])).alias("c")).select("c.*")
    middle = cells.where("raw IS NOT NULL").groupBy("header", "metric_key", "transform", "factor").agg(F.sort_array(F.collect_list(F.col("raw") * F.col("factor"))).alias("v"))
    middle = middle.where(F.size("v") >= 2).select("header", "metric_key", "transform", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("median"))
    spark = rows.sparkSession
    ranges = spark.createDataFrame([(k, float(a), float(z)) for k, (a, z) in PLAUSIBLE_RANGES.items()], "metric_key string, low double, high double")
    factors = spark.createDataFrame([(m, i, t, TRANSFORMS[t]) for m, ts in CANDIDATES.items() for i, t in enumerate(ts)], "metric_key string, place int, candidate string, candidate_factor double")
    out = middle.join(F.broadcast(ranges), "metric_key").where("median < low OR median > high").join(F.broadcast(factors), "metric_key", "left")
    own = reduce(lambda c, t: c.when(F.col("transform") == t, TRANSFORMS[t]), TRANSFORMS, F.when(F.lit(False), 1.0))
    tried = F.col("median") / own * F.col("candidate_factor")
    fits = tried.between(F.col("low"), F.col("high")) & (F.col("candidate") != F.col("transform"))
    return out.groupBy("header", "metric_key", "median").agg(F.min_by(F.when(fits, F.col("candidate")), F.when(fits, F.col("place"))).alias("suggested"))


def checked_plan(rows: DataFrame, plan: ImportPlan, order: str) -> ImportPlan:
    """The plan with low confidence, and a warning, where a column's values are out of range.

    A row a mapped column reaches the driver. At most ten warnings, the plan's own first.
    """
    if plan.kind != "metrics" or not any(c.metric in PLAUSIBLE_RANGES for c in plan.columns):
        return plan
    found = {r["header"]: r for r in implausible(rows, plan, order).collect()}
    columns, warnings = [], list(plan.warnings)
    for c in plan.columns:
        if c.header in found and c.metric in PLAUSIBLE_RANGES:
            low, high = PLAUSIBLE_RANGES[c.metric]
            about, other = f"{found[c.header]['median']:.4g}", found[c.header]["suggested"]
            warnings.append(f"{c.header}: as {c.metric} about {about}, expected {low:g} to {high:g}; " + (f"{other} would fit" if other else "check the unit"))
            c = replace(c, confidence="low", reasoning=f"{c.reasoning}; about {about} is not within {low:g} to {high:g}".removeprefix("; "))
        columns.append(c)
    return replace(plan, columns=tuple(columns), warnings=tuple(warnings[:WARNINGS]))


def fingerprint(fields: list[Column]) -> Column:
    """32-bit FNV-1a of joined fields, as an integer."""
    text = F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    mask = 0xFFFFFFFF
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(mask))


def occurrence_ids(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """``rows`` with an id of their content and the number of the occurrence, in ``order``."""
    h = rows.withColumn("_h", fingerprint([F.col(f) for f in fields]))
    n = F.row_number().over(Window.partitionBy("_h").orderBy(order))
    return h.withColumn("content_id", F.concat(F.lit("csv:"), F.lower(F.conv(F.col("_h").cast("string"), 10, 36)), F.when(n > 1, F.concat(F.lit("."), n.cast("string"))).otherwise(""))).drop("_h")


def civil_date(document: Column) -> Column:
    """A day from a string, a {year, month, day} object, or one nested below ``date`` or ``civilTime.date``."""
    def parts(path: str) -> Column:
        number = lambda part: F.get_json_object(document, f"$.{path}{part}").try_cast("int")
        text = lambda y: F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), number("month"), F.lit("-"), number("day"))
        # A cast, because a parser's exception for each object that is elsewhere costs more than all the rest.
        return bind(number("year"), lambda y: F.when(y.between(0, 9999), text(y).try_cast("date")))

    plain = F.when(document.rlike(r'^"?\d{4}-\d{2}-\d{2}'), F.regexp_extract(document, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))
    return F.coalesce(plain, parts("date."), parts("civilTime.date."), parts(""))


def api_number(value: Column) -> Column:
    """A number, an integer sent as text, or seconds such as ``36120s``."""
    return F.regexp_replace(value, "s$", "").try_cast("double")


# Kind of document, its fields (first that is there), metric key and factor.
FIELDS: dict[str, list[tuple[tuple[str, ...], str, float]]] = {
    "steps": [(("countSum",), "steps", 1.0)],
    "distance": [(("millimetersSum",), "distance_km", 1e-6)],
    "floors": [(("countSum",), "floors", 1.0)],
    "heart-rate": [(("beatsPerMinuteAvg",), "avg_hr", 1.0), (("beatsPerMinuteMax",), "max_hr_daily", 1.0), (("beatsPerMinuteMin",), "min_hr_daily", 1.0)],
    "total-calories": [(("kcalSum",), "calories_out", 1.0)],
    "active-energy-burned": [(("kcalSum",), "active_calories", 1.0)],
    "sedentary-period": [(("durationSum",), "sedentary_min", 1 / 60)],
    "nutrition-log": [(("kcalSum",), "calories_in", 1.0), (("proteinGramsSum",), "protein_g", 1.0), (("carbohydrateGramsSum", "carbsGramsSum"), "carbs_g", 1.0), (("fatGramsSum",), "fat_g", 1.0)],
    "hydration-log": [(("millilitersSum",), "water_l", 1e-3)],
    "daily-resting-heart-rate": [(("beatsPerMinute",), "resting_hr", 1.0)],
    "daily-heart-rate-variability": [(("averageHeartRateVariabilityMilliseconds",), "hrv_ms", 1.0), (("deepSleepRootMeanSquareOfSuccessiveDifferencesMilliseconds",), "hrv_deep_ms", 1.0)],
    "daily-oxygen-saturation": [(("averagePercentage",), "spo2_pct", 1.0)],
    "daily-respiratory-rate": [(("breathsPerMinute",), "respiratory_rate", 1.0)],
    "daily-vo2-max": [(("vo2Max",), "vo2max", 1.0)],
    "weight": [(("weightGrams",), "weight_kg", 1e-3)],
    "body-fat": [(("percentage", "bodyFatPercentage"), "body_fat_pct", 1.0)],
    "height": [(("heightMillimeters",), "height_cm", 0.1)],
}
ZONES = ("sumInFatBurnHeartZone", "sumInCardioHeartZone", "sumInPeakHeartZone")
LEVELS = "array<struct<activityLevel:string,activeMinutesSum:string>>"


def extracted(kind: str, body: Column) -> Column:
    """The (metric_key, value) pairs of one document of a kind; values may be null."""
    number = lambda name: api_number(F.get_json_object(body, f"$.{name}"))
    pair = lambda key, value: F.struct(F.lit(key).alias("metric_key"), value.cast("double").alias("value"))
    if kind == "active-zone-minutes":
        zones = F.filter(F.array(*map(number, ZONES)), lambda z: z.isNotNull())
        return F.array(pair("active_zone_min", F.when(F.size(zones) > 0, F.aggregate(zones, F.lit(0.0), lambda a, z: a + z))))
    if kind == "active-minutes":
        levels = F.from_json(F.get_json_object(body, "$.activeMinutesRollupByActivityLevel"), LEVELS)
        total = lambda r: F.aggregate(F.transform(r, lambda x: F.coalesce(api_number(x["activeMinutesSum"]), F.lit(0.0))), F.lit(0.0), lambda a, m: a + m)

        def minutes(rows: Column) -> Column:
            positive = bind(total(F.filter(rows, lambda x: x["activityLevel"] != "LIGHT")), lambda brisk: F.when(brisk > 0, brisk))
            return F.array(pair("active_minutes", F.when(F.size(rows) > 0, total(rows))), pair("moderate_vigorous_min", positive))

        return bind(levels, minutes)
    return F.array(*[pair(key, F.coalesce(*map(number, names)) * factor) for names, key, factor in FIELDS[kind]])


def dated(day: Column, pairs: Column) -> Column:
    """The pairs as rows (date, metric_key, value), read once: a condition on these rows stays above, where one on columns would read each document again."""
    return F.explode_outer(bind(civil_date(day), lambda d: F.when(d.isNotNull(), F.transform(pairs, lambda p: F.struct(d.alias("date"), p["metric_key"].alias("metric_key"), p["value"].alias("value"))))))


def api_points(documents: DataFrame, kind: str) -> DataFrame:
    """(date, metric_key, value) from JSON documents (seq, day, body) of one kind; the last of a day wins."""
    rows = documents.select("seq", dated(F.col("day"), extracted(kind, F.col("body"))).alias("f"))
    rows = rows.select("seq", "f.*").where("date IS NOT NULL AND value IS NOT NULL")
    return rows.groupBy("date", "metric_key").agg(F.max_by("value", "seq").alias("value"))


def sleep_nights(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """Nightly metrics from sleep sessions.

    ``sessions``: keys, session_id, start_ts, end_ts, offset_s, is_main, minutes_asleep,
    minutes_in_period, deep, rem, awake. A night belongs to the day it ends on; its main
    sleep is the one flagged, else the longest. A nap is a session that overlaps the main
    sleep by less than half its length; others are copies of it.
    """
    span = (F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")) / 60.0
    s = sessions.withColumn("date", F.to_date("end_ts")).withColumn("asleep", F.coalesce("minutes_asleep", span)).withColumn("period", F.coalesce("minutes_in_period", span))
    w = Window.partitionBy(*keys, "date").orderBy(F.desc(F.coalesce("is_main", F.lit(False))), F.when(F.coalesce("is_main", F.lit(False)), F.lit(0.0)).otherwise(-F.col("asleep")), "session_id")
    s = s.withColumn("_k", F.row_number().over(w)).withColumn("a", F.unix_timestamp("start_ts").cast("double")).withColumn("z", F.col("a") + F.col("period") * 60)
    main = s.where("_k = 1")
    others = s.where("_k > 1").join(main.select(*keys, "date", F.col("a").alias("ma"), F.col("z").alias("mz")), [*keys, "date"])
    overlap = F.least("z", "mz") - F.greatest("a", "ma")
    naps = others.where((overlap <= 0) | (overlap < 0.5 * (F.col("z") - F.col("a")))).groupBy(*keys, "date").agg(F.sum("asleep").alias("nap"))
    local = F.pmod(F.unix_timestamp("start_ts") + F.coalesce("offset_s", F.lit(0)), F.lit(86400))
    hour = F.floor(local / 60) / 60.0
    positive = lambda c: F.when(c > 0, c)
    values = {
        "sleep_hours": positive(F.col("asleep")) / 60.0,
        "sleep_efficiency": F.when((F.col("period") > 0) & (F.col("asleep") > 0), F.least(F.lit(100.0), F.try_divide("asleep", "period") * 100)),
        "deep_sleep_min": positive(F.col("deep")), "rem_sleep_min": positive(F.col("rem")), "sleep_awake_min": positive(F.col("awake")), "nap_min": positive(F.col("nap")),
        "sleep_start_hour": F.when(hour > 12, hour - 24).otherwise(hour),
    }
    nights = main.join(naps, [*keys, "date"], "left").select(*keys, "date", *[v.alias(k) for k, v in values.items()])
    return nights.unpivot([*keys, "date"], list(values), "metric_key", "value").where("value IS NOT NULL")


def exercise_sessions(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """API sessions (start_ts, end_ts, active_s, …) with a possible duration, up to six hours, in the date range."""
    span = (F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts")) / 60.0
    minutes = F.coalesce(F.col("active_s") / 60.0, span)
    rows = sessions.withColumn("date", F.to_date("start_ts")).withColumn("duration_min", F.when((minutes > 0) & (minutes <= 360), minutes))
    return rows.where(F.col("duration_min").isNotNull() & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


# Patterns of sync errors, what they mean, and whether nothing at all must have worked.
DIAGNOSES: tuple[tuple[str, str, bool], ...] = (
    (r"(?i)has not been used in project|is disabled", "api_disabled", False),
    (r"(?i)\b401\b|UNAUTHENTICATED|invalid_grant|Invalid Credentials", "connection_expired", False),
    (r"(?i)\b403\b|PERMISSION_DENIED|insufficient|scope", "scopes_missing", True),
)


def diagnose(log: DataFrame, run: str) -> DataFrame:
    """One diagnosis for each sync run of a log (run, type, ok, message); null where nothing failed."""
    runs = log.groupBy(run).agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("message")))), "\n").alias("_all"))
    nothing = F.col("n_ok") == 0
    found = F.when(F.col("n_failed") == 0, F.lit(None).cast("string"))
    for pattern, name, alone in DIAGNOSES:
        found = found.when(F.col("_all").rlike(pattern) & (nothing if alone else F.lit(True)), name)
    return runs.select(run, "n_ok", "n_failed", found.when(~nothing, "some_types_empty").otherwise("all_failed").alias("diagnosis"))
