"""Closed vocabularies. All values here are fixed: they define the data model."""

from __future__ import annotations

# Key, label, unit, category, higher is better (None: no direction), daily aggregate, decimals.
CORE_METRICS: list[tuple[str, str, str, str, bool | None, str, int]] = [
    ("weight_kg", "Weight", "kg", "body", None, "mean", 2),
    ("body_fat_pct", "Body fat", "%", "body", False, "mean", 1),
    ("lean_mass_kg", "Lean mass", "kg", "body", True, "mean", 2),
    ("fat_mass_kg", "Fat mass", "kg", "body", False, "mean", 2),
    ("waist_cm", "Waist", "cm", "body", False, "mean", 1),
    ("resting_hr", "Resting HR", "bpm", "cardio", False, "mean", 0),
    ("hrv_ms", "HRV (RMSSD)", "ms", "cardio", True, "mean", 0),
    ("vo2max", "VO2 max", "ml/kg", "cardio", True, "mean", 1),
    ("spo2_pct", "SpO2", "%", "cardio", True, "mean", 1),
    ("respiratory_rate", "Respiratory rate", "br/m", "cardio", False, "mean", 1),
    ("avg_hr", "Average HR", "bpm", "cardio", None, "mean", 0),
    ("max_hr_daily", "Peak HR", "bpm", "cardio", None, "max", 0),
    ("min_hr_daily", "Lowest HR", "bpm", "cardio", False, "min", 0),
    ("hrv_deep_ms", "HRV (deep sleep)", "ms", "cardio", True, "mean", 0),
    ("height_cm", "Height", "cm", "body", None, "last", 0),
    ("active_calories", "Active calories", "kcal", "activity", None, "sum", 0),
    ("moderate_vigorous_min", "Mod+vigorous", "min", "activity", True, "sum", 0),
    ("sleep_hours", "Sleep duration", "h", "sleep", True, "sum", 2),
    ("sleep_efficiency", "Sleep efficiency", "%", "sleep", True, "mean", 1),
    ("deep_sleep_min", "Deep sleep", "min", "sleep", True, "sum", 0),
    ("rem_sleep_min", "REM sleep", "min", "sleep", True, "sum", 0),
    ("sleep_start_hour", "Bedtime", "h", "sleep", None, "mean", 2),
    ("sleep_awake_min", "Awake in bed", "min", "sleep", False, "sum", 0),
    ("nap_min", "Naps", "min", "sleep", None, "sum", 0),
    ("steps", "Steps", "", "activity", True, "sum", 0),
    ("distance_km", "Distance", "km", "activity", True, "sum", 2),
    ("floors", "Floors", "", "activity", True, "sum", 0),
    ("active_zone_min", "Active zone min", "min", "activity", True, "sum", 0),
    ("active_minutes", "Active minutes", "min", "activity", True, "sum", 0),
    ("sedentary_min", "Sedentary time", "min", "activity", False, "sum", 0),
    ("calories_out", "Calories burned", "kcal", "activity", None, "sum", 0),
    ("training_load", "Training load", "au", "activity", None, "sum", 0),
    ("workout_min", "Workout time", "min", "activity", True, "sum", 0),
    ("training_volume_kg", "Training volume", "kg", "strength", True, "sum", 0),
    ("sets_count", "Sets", "", "strength", True, "sum", 0),
    ("hard_sets", "Hard sets (RPE 7+)", "", "strength", True, "sum", 0),
    ("reps_total", "Total reps", "", "strength", True, "sum", 0),
    ("top_set_kg", "Heaviest set", "kg", "strength", True, "max", 1),
    ("strength_index", "Strength index", "kg", "strength", True, "last", 1),
    ("ctl", "Fitness (CTL)", "au", "derived", True, "last", 1),
    ("atl", "Fatigue (ATL)", "au", "derived", None, "last", 1),
    ("tsb", "Form (TSB)", "au", "derived", None, "last", 1),
    ("acwr", "Acute:chronic", "x", "derived", None, "last", 2),
    ("readiness", "Readiness", "/100", "derived", True, "last", 0),
    ("calories_in", "Calories eaten", "kcal", "nutrition", None, "sum", 0),
    ("protein_g", "Protein", "g", "nutrition", True, "sum", 0),
    ("carbs_g", "Carbs", "g", "nutrition", None, "sum", 0),
    ("fat_g", "Fat", "g", "nutrition", None, "sum", 0),
    ("alcohol_units", "Alcohol", "units", "nutrition", False, "sum", 1),
    ("water_l", "Water", "L", "nutrition", True, "sum", 2),
    ("deep_work_hours", "Deep work", "h", "work", True, "sum", 2),
    ("revenue", "Revenue", "", "work", True, "sum", 2),
    ("mrr", "MRR", "", "work", True, "last", 2),
    ("customers", "Customers", "", "work", True, "last", 0),
    ("sales_calls", "Sales calls", "", "work", True, "sum", 0),
    ("shipped_items", "Things shipped", "", "work", True, "sum", 0),
    ("focus_score", "Focus", "/10", "cognitive", True, "mean", 1),
    ("mood", "Mood", "/10", "cognitive", True, "mean", 1),
    ("energy", "Energy", "/10", "cognitive", True, "mean", 1),
    ("stress", "Stress", "/10", "cognitive", False, "mean", 1),
    ("meditation_min", "Meditation", "min", "cognitive", True, "sum", 0),
    ("reading_min", "Reading", "min", "cognitive", True, "sum", 0),
    ("screen_time_h", "Screen time", "h", "cognitive", False, "sum", 2),
]

# Metrics computed from others; a pair is excluded in either direction.
DERIVED_FROM: dict[str, list[str]] = {
    "lean_mass_kg": ["weight_kg", "body_fat_pct", "fat_mass_kg"],
    "fat_mass_kg": ["weight_kg", "body_fat_pct", "lean_mass_kg"],
    "readiness": ["hrv_ms", "resting_hr", "sleep_hours", "tsb"],
    "ctl": ["training_load", "atl", "tsb", "acwr", "workout_min"],
    "atl": ["training_load", "ctl", "tsb", "acwr", "workout_min"],
    "tsb": ["training_load", "ctl", "atl", "acwr"],
    "acwr": ["training_load", "ctl", "atl", "tsb"],
    "training_load": ["workout_min", "ctl", "atl", "tsb", "acwr"],
}

# Plausible daily values.
PLAUSIBLE_RANGES: dict[str, tuple[float, float]] = {
    "weight_kg": (30, 250), "lean_mass_kg": (20, 150), "fat_mass_kg": (1, 120),
    "body_fat_pct": (3, 60), "waist_cm": (40, 200), "height_cm": (100, 250),
    "resting_hr": (30, 110), "avg_hr": (35, 180), "hrv_ms": (5, 250),
    "spo2_pct": (70, 100), "respiratory_rate": (5, 35), "vo2max": (15, 90),
    "sleep_hours": (0, 14), "sleep_efficiency": (30, 100),
    "deep_sleep_min": (0, 400), "rem_sleep_min": (0, 400), "nap_min": (0, 400),
    "steps": (0, 60000), "distance_km": (0, 300), "floors": (0, 500),
    "active_zone_min": (0, 600), "active_minutes": (0, 900), "sedentary_min": (0, 1440),
    "calories_in": (300, 9000), "calories_out": (500, 9000), "protein_g": (0, 500),
    "carbs_g": (0, 1200), "fat_g": (0, 500), "water_l": (0, 12), "alcohol_units": (0, 40),
    "deep_work_hours": (0, 16), "screen_time_h": (0, 24), "meditation_min": (0, 300),
    "training_volume_kg": (0, 100000), "sets_count": (0, 100), "hard_sets": (0, 80),
    "reps_total": (0, 1500), "top_set_kg": (0, 500), "strength_index": (0, 2000),
    "reading_min": (0, 600),
    "focus_score": (0, 10), "mood": (0, 10), "energy": (0, 10), "stress": (0, 10),
}

# Precedence of sources for one (date, metric); others have 0.
SOURCE_PRIORITY = {"manual": 100, "csv": 80, "google_health": 60, "photo": 40, "derived": 20}
# Precedence of sources of one workout.
WORKOUT_RANK = {"manual": 3, "csv": 2, "google_health": 1}

# Unit conversions, all multiples.
TRANSFORMS: dict[str, float] = {
    "none": 1.0, "lb_to_kg": 0.45359237, "st_to_kg": 6.35029318, "g_to_kg": 1 / 1000,
    "mi_to_km": 1.609344, "m_to_km": 1 / 1000, "mm_to_km": 1 / 1e6, "ft_to_m": 0.3048,
    "in_to_cm": 2.54, "s_to_min": 1 / 60, "s_to_h": 1 / 3600, "min_to_h": 1 / 60,
    "h_to_min": 60.0, "ms_to_s": 1 / 1000, "fraction_to_pct": 100.0, "pct_to_fraction": 1 / 100,
}
# Conversions that make sense for a metric's unit, in the order they are tried.
_HOURS, _MINUTES = ["none", "s_to_h", "min_to_h"], ["none", "s_to_min", "h_to_min"]
_MASS, _LENGTH = ["none", "lb_to_kg", "st_to_kg", "g_to_kg"], ["none", "mi_to_km", "m_to_km", "mm_to_km"]
_SHARE = ["none", "fraction_to_pct", "pct_to_fraction"]
CANDIDATES: dict[str, list[str]] = {
    **dict.fromkeys(("sleep_hours", "deep_work_hours", "screen_time_h"), _HOURS),
    **dict.fromkeys(("deep_sleep_min", "rem_sleep_min", "nap_min", "active_zone_min", "active_minutes", "sedentary_min", "meditation_min"), _MINUTES),
    **dict.fromkeys(("weight_kg", "lean_mass_kg", "fat_mass_kg"), _MASS),
    "distance_km": _LENGTH,
    **dict.fromkeys(("waist_cm", "height_cm"), ["none", "in_to_cm"]),
    **dict.fromkeys(("body_fat_pct", "sleep_efficiency", "spo2_pct"), _SHARE),
}

# Header names of common exports, for daily metrics and for workouts.
ALIASES: dict[str, list[str]] = {
    "date": ["date", "day", "timestamp", "start time", "start_date", "start date", "activity date", "datetime", "time", "start_date_local", "cycle start time"],
    "weight_kg": ["weight", "weight (kg)", "weight_kg", "body weight", "bodyweight", "mass"],
    "body_fat_pct": ["fat", "body fat", "body fat %", "bodyfat", "body_fat", "fat %", "fat percentage"],
    "steps": ["steps", "step count", "total steps", "daily steps"],
    "resting_hr": ["resting heart rate", "resting hr", "rhr", "resting_heart_rate"],
    "hrv_ms": ["hrv", "heart rate variability", "hrv (ms)", "rmssd", "heart rate variability (ms)"],
    "sleep_hours": ["sleep", "sleep duration", "hours of sleep", "asleep time", "sleep (h)", "time asleep", "sleep hours"],
    "sleep_efficiency": ["sleep efficiency", "efficiency", "sleep score", "sleep performance %"],
    "deep_sleep_min": ["deep sleep", "minutes deep sleep", "deep (min)", "deep sleep duration"],
    "rem_sleep_min": ["rem sleep", "minutes rem sleep", "rem (min)", "rem sleep duration"],
    "calories_out": ["calories burned", "calories out", "total calories", "energy burned", "active calories"],
    "calories_in": ["calories", "calories in", "energy", "kcal", "calories consumed"],
    "protein_g": ["protein", "protein (g)", "protein_g"],
    "carbs_g": ["carbs", "carbohydrates", "carbs (g)"],
    "fat_g": ["fat (g)", "fat_g", "total fat"],
    "distance_km": ["distance", "distance (km)", "distance_km", "total distance"],
    "vo2max": ["vo2 max", "vo2max", "vo2_max", "cardio fitness score"],
    "spo2_pct": ["spo2", "oxygen saturation", "spo2 %", "blood oxygen"],
    "active_zone_min": ["active zone minutes", "azm", "zone minutes"],
    "mood": ["mood", "mood score", "feeling"],
    "energy": ["energy", "energy level"],
    "stress": ["stress", "stress level", "stress score"],
    "focus_score": ["focus", "focus score", "concentration"],
    "deep_work_hours": ["deep work", "deep work hours", "focus hours", "focused time"],
    "revenue": ["revenue", "sales", "income", "mrr delta"],
    "mrr": ["mrr", "monthly recurring revenue"],
    "waist_cm": ["waist", "waist (cm)", "waist circumference"],
}
WORKOUT_ALIASES: dict[str, list[str]] = {
    "type": ["activity type", "type", "sport", "activity", "workout type", "exercise"],
    "name": ["activity name", "name", "title", "description"],
    "duration_min": ["duration", "elapsed time", "moving time", "time", "total time", "duration (min)", "activity duration"],
    "distance_km": ["distance", "distance (km)", "total distance"],
    "avg_hr": ["average heart rate", "avg hr", "average hr", "heart rate average", "avg heart rate"],
    "max_hr": ["max heart rate", "max hr", "maximum heart rate"],
    "calories": ["calories", "calories burned", "energy"],
    "elevation_m": ["elevation gain", "total ascent", "elevation", "ascent"],
    "rpe": ["rpe", "perceived exertion", "effort", "relative effort"],
    "date": ALIASES["date"],
}

# Published population anchors (percentile: value) by sex and age decade.
PERCENTILES = (10, 25, 50, 75, 90)
DECADES = ("20s", "30s", "40s", "50s", "60s", "70s")
ANCHORS: dict[str, dict[str, list[list[float]]]] = {
    "vo2max": {
        "male": [[34, 41, 48.0, 55, 61], [30, 36, 42.4, 49, 55], [27, 32, 37.8, 44, 50], [23, 28, 32.6, 38, 44], [20, 24, 28.2, 33, 39], [17, 21, 24.4, 29, 34]],
        "female": [[27, 32, 37.6, 44.7, 51.3], [22, 26, 30.2, 36, 41], [20, 23, 26.7, 32, 37], [17, 20, 23.4, 28, 33], [15, 17, 20.0, 24, 28], [13, 16, 18.3, 22, 26]],
    },
    "resting_hr": {
        "male": [[52, 57, 66, 73, 80], [53, 58, 66, 74, 81], [54, 59, 67, 75, 82], [55, 60, 68, 76, 83], [55, 60, 68, 76, 83], [56, 61, 69, 77, 84]],
        "female": [[56, 61, 70, 77, 84], [57, 62, 70, 78, 85], [58, 63, 71, 79, 86], [58, 63, 71, 79, 86], [59, 64, 72, 80, 87], [59, 64, 72, 80, 87]],
    },
    "steps": {
        "male": [[2600 - 150 * i, 4200 - 200 * i, 6500 - 350 * i, 9500 - 500 * i, 12800 - 700 * i] for i in range(6)],
        "female": [[2400 - 140 * i, 3900 - 190 * i, 6000 - 330 * i, 8800 - 470 * i, 11800 - 650 * i] for i in range(6)],
    },
}
HIGHER_IS_BETTER = {"vo2max": True, "resting_hr": False, "steps": True}
# One-rep maximum over body weight; the pattern names the lift.
LIFTS: dict[str, tuple[str, dict[str, list[float]]]] = {
    "squat": (r"(?i)\bsquat\b", {"male": [0.75, 1.10, 1.65, 2.20, 2.83], "female": [0.55, 0.85, 1.30, 1.75, 2.25]}),
    "bench": (r"(?i)bench\s*press", {"male": [0.55, 0.80, 1.20, 1.60, 1.95], "female": [0.30, 0.45, 0.70, 0.95, 1.20]}),
    "deadlift": (r"(?i)deadlift", {"male": [1.00, 1.40, 2.00, 2.65, 3.25], "female": [0.70, 1.05, 1.55, 2.05, 2.55]}),
}

# The metrics of the snapshot section.
KEY_SNAPSHOT_METRICS = [
    "weight_kg", "body_fat_pct", "lean_mass_kg", "resting_hr", "hrv_ms", "sleep_hours",
    "readiness", "steps", "active_zone_min", "ctl", "tsb", "deep_work_hours", "focus_score", "vo2max",
]


def is_derived_pair(a: str, b: str) -> bool:
    return b in DERIVED_FROM.get(a, ()) or a in DERIVED_FROM.get(b, ())


# Metrics that a report takes as candidate drivers, and those it watches beside the goals' own.
DRIVER_CANDIDATES = (
    "sleep_hours", "sleep_efficiency", "deep_sleep_min", "rem_sleep_min", "sleep_start_hour",
    "hrv_ms", "resting_hr", "steps", "active_zone_min", "training_load", "workout_min",
    "calories_in", "protein_g", "alcohol_units", "water_l", "tsb",
    "meditation_min", "screen_time_h", "stress", "energy",
)
WATCHED = ("weight_kg", "resting_hr", "hrv_ms", "sleep_hours", "readiness")
