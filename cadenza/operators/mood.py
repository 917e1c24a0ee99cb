"""Mood scores: profile distance, audio signals, keywords, rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.columns import clamp, labels_where, total, try_double

# Sequencing moods as feature -> (target, tolerance), with the tempo and energy steps
# that still sound smooth.
MOOD_PROFILES = {
    "workout": {
        "features": {
            "danceability": (0.78, 0.25), "energy": (0.86, 0.25), "valence": (0.72, 0.30),
            "tempo": (132.0, 28.0), "acousticness": (0.18, 0.30),
        },
        "tempo_step": 16.0, "energy_step": 0.22,
    },
    "study": {
        "features": {
            "danceability": (0.45, 0.22), "energy": (0.35, 0.22), "valence": (0.40, 0.25),
            "tempo": (95.0, 18.0), "acousticness": (0.70, 0.35),
        },
        "tempo_step": 10.0, "energy_step": 0.12,
    },
    "happy": {
        "features": {
            "danceability": (0.72, 0.25), "energy": (0.70, 0.25), "valence": (0.82, 0.20),
            "tempo": (118.0, 24.0), "acousticness": (0.30, 0.30),
        },
        "tempo_step": 14.0, "energy_step": 0.18,
    },
    "calm": {
        "features": {
            "danceability": (0.42, 0.20), "energy": (0.24, 0.18), "valence": (0.42, 0.22),
            "tempo": (82.0, 16.0), "acousticness": (0.82, 0.25),
        },
        "tempo_step": 8.0, "energy_step": 0.10,
    },
    "melancholic": {
        "features": {
            "danceability": (0.38, 0.20), "energy": (0.30, 0.18), "valence": (0.20, 0.18),
            "tempo": (78.0, 18.0), "acousticness": (0.72, 0.28),
        },
        "tempo_step": 8.0, "energy_step": 0.10,
    },
    "focus": {
        "features": {
            "danceability": (0.46, 0.22), "energy": (0.32, 0.18), "valence": (0.38, 0.22),
            "tempo": (92.0, 16.0), "acousticness": (0.68, 0.30),
        },
        "tempo_step": 8.0, "energy_step": 0.10,
    },
}

# Signal weights per scoring mood.
POSITIVE_SIGNALS = {
    "workout": {"energy": 0.38, "danceability": 0.30, "tempo_fast": 0.22},
    "happy": {"valence": 0.48, "energy": 0.25, "danceability": 0.20, "tempo_fast": 0.07},
    "melancholic": {"low_valence": 0.38, "acousticness": 0.22, "medium_low_energy": 0.25, "tempo_slow": 0.15},
    "party": {"energy": 0.32, "danceability": 0.32, "tempo_fast": 0.20, "popularity": 0.16},
    "study": {"instrumentalness": 0.35, "acousticness": 0.25, "low_energy": 0.22, "tempo_slow": 0.18},
    "calm": {"acousticness": 0.30, "instrumentalness": 0.25, "low_energy": 0.25, "tempo_slow": 0.20},
}
PENALTY_SIGNALS = {
    "workout": {"acousticness": 0.25, "instrumentalness": 0.20, "low_energy": 0.35, "tempo_slow": 0.20},
    "happy": {"low_valence": 0.65, "low_energy": 0.35},
    "melancholic": {"valence": 0.35, "danceability": 0.30, "energy": 0.20, "tempo_fast": 0.15},
    "party": {"low_energy": 0.40, "acousticness": 0.30, "tempo_slow": 0.30},
    "study": {"danceability": 0.30, "energy": 0.35, "tempo_fast": 0.35},
    "calm": {"energy": 0.40, "tempo_fast": 0.25, "danceability": 0.20, "not_acoustic": 0.15},
}

# Words for and against a mood. Matching is by substring.
MOOD_WORDS = {
    "workout": ["workout", "run", "running", "gym", "power", "hype", "pump", "energy", "beat", "dance"],
    "happy": ["happy", "sunshine", "love", "good", "smile", "joy", "sweet", "dance", "bright"],
    "melancholic": ["sad", "lonely", "blue", "heartbreak", "cry", "rain", "empty", "slow", "acoustic"],
    "party": ["party", "club", "dance", "remix", "beat", "night", "dj", "hype"],
    "study": ["acoustic", "piano", "instrumental", "soft", "calm", "ambient", "chill", "study", "lo-fi", "lofi", "sleep"],
    "calm": ["acoustic", "piano", "instrumental", "soft", "calm", "ambient", "chill", "study", "lo-fi", "lofi", "sleep"],
}
BLOCKED_WORDS = {
    "workout": ["sleep", "lullaby", "acoustic", "piano", "slow", "calm", "sad"],
    "happy": ["sad", "lonely", "cry", "heartbreak", "dark"],
    "melancholic": ["party", "hype", "club", "happy", "sunshine", "dance"],
    "party": ["acoustic", "piano", "sleep", "calm", "sad", "slow"],
    "study": ["party", "hype", "club", "dance", "remix", "workout"],
    "calm": ["party", "hype", "club", "dance", "remix", "workout"],
}
SCORING_MOODS = list(POSITIVE_SIGNALS)
SEQUENCING_MOODS = list(MOOD_PROFILES)
METADATA_ONLY = "metadata-only"
TEXT_COLUMNS = ["track_name", "artist_name", "artist_genres", "candidate_sources", "search_query"]


def sequencing_profile(mood: str) -> dict:
    """Profile of a sequencing mood; an unknown mood is an error."""
    key = mood.strip().lower()
    if key not in MOOD_PROFILES:
        raise ValueError(f"unknown mood {mood!r}; known moods: {', '.join(sorted(MOOD_PROFILES))}")
    return MOOD_PROFILES[key]


def scoring_mood(mood: str) -> str:
    """Scoring falls back to calm for a mood it does not know."""
    key = mood.strip().lower()
    return key if key in POSITIVE_SIGNALS else "calm"


def mood_relevance(mood: str, features: dict[str, Column] | None = None) -> Column:
    """Mean over the profile's features of max(0, 1 - distance / tolerance)."""
    profile = sequencing_profile(mood)["features"]
    parts = []
    for name, (target, tolerance) in profile.items():
        value = (features or {}).get(name, F.col(name))
        distance = F.abs(F.coalesce(value, F.lit(target)) - target) / max(tolerance, 1e-6)
        parts.append(F.greatest(F.lit(0.0), 1.0 - distance))
    return total(parts) / len(parts)


def audio_signals(columns: list[str] | None = None) -> dict[str, Column]:
    """Derived signals in [0, 1] from the audio columns of a row; an absent column is neutral."""

    def number(name: str, default: float) -> Column:
        return try_double(F.col(name), default) if columns is None or name in columns else F.lit(default)

    energy = clamp(number("energy", 0.5))
    dance = clamp(number("danceability", 0.5))
    valence = clamp(number("valence", 0.5))
    acoustic = clamp(number("acousticness", 0.5))
    tempo = number("tempo", 120.0)
    return {
        "energy": energy,
        "danceability": dance,
        "valence": valence,
        "acousticness": acoustic,
        "instrumentalness": clamp(number("instrumentalness", 0.0)),
        "tempo_fast": clamp((tempo - 90.0) / 70.0),
        "tempo_slow": 1.0 - clamp((tempo - 70.0) / 80.0),
        "popularity": clamp(number("catalog_popularity", 0.0)),
        "not_acoustic": 1.0 - acoustic,
        "low_energy": 1.0 - energy,
        "medium_low_energy": 1.0 - F.abs(energy - 0.35),
        "low_valence": 1.0 - valence,
    }


def calibrated(positive: Column, penalty: Column) -> Column:
    return clamp(0.72 * positive + 0.28 * (1.0 - penalty))


def _weighted(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    return clamp(total([signals[n] * w for n, w in weights.items()]) / sum(weights.values()))


def audio_mood_score(mood: str, columns: list[str] | None = None) -> Column:
    m, s = scoring_mood(mood), audio_signals(columns)
    return calibrated(_weighted(s, POSITIVE_SIGNALS[m]), _weighted(s, PENALTY_SIGNALS[m]))


def _top_signals(weights: dict[str, float], columns: list[str]) -> Column:
    s = audio_signals(columns)
    rows = F.array(
        *[F.struct((-(s[n] * w)).alias("o"), F.lit(n).alias("n")) for n, w in weights.items()]
    )
    best = F.filter(F.slice(F.array_sort(rows), 1, 3), lambda r: r["o"] < -0.05)
    return F.transform(best, lambda r: F.replace(r["n"], F.lit("_"), F.lit(" ")))


def mood_text(available: list[str]) -> Column:
    """Searchable lower-case text of a row from the columns that exist."""
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in available else F.lit("") for c in TEXT_COLUMNS]
    return F.lower(F.concat_ws(" ", *present))


def keyword_mood_score(mood: str, text: Column) -> Column:
    m = scoring_mood(mood)
    words, blocked = MOOD_WORDS[m], BLOCKED_WORDS[m]

    def hits(terms: list[str]) -> Column:
        return total([text.contains(t).cast("int") for t in terms])

    source = F.when(text.contains("search"), 0.12).otherwise(0.0)
    core = F.when(hits(words[:4]) > 0, 0.15).otherwise(0.0)
    positive = F.least(F.lit(1.0), 0.22 * hits(words) + source + core)
    penalty = F.least(F.lit(1.0), 0.28 * hits(blocked))
    return calibrated(positive, penalty)


def keyword_signals(terms: list[str], text: Column) -> Column:
    return F.slice(labels_where([(text.contains(t), t) for t in terms]), 1, 4)


def mood_score(mood: str, columns: list[str]) -> Column:
    """Keyword score for rows without audio features, audio score otherwise."""
    audio = audio_mood_score(mood, columns)
    if "ranking_mode" not in columns:
        return audio
    return F.when(F.col("ranking_mode") == METADATA_ONLY, keyword_mood_score(mood, mood_text(columns))).otherwise(audio)


def mood_details(mood: str, columns: list[str]) -> list[Column]:
    """mood_score, mood_mode, positive_signals and penalty_signals of a row."""
    m, text = scoring_mood(mood), mood_text(columns)
    by_text = F.col("ranking_mode") == METADATA_ONLY if "ranking_mode" in columns else F.lit(False)
    return [
        mood_score(mood, columns).alias("mood_score"),
        F.when(by_text, "metadata_only").otherwise("audio_features").alias("mood_mode"),
        F.when(by_text, keyword_signals(MOOD_WORDS[m], text)).otherwise(_top_signals(POSITIVE_SIGNALS[m], columns)).alias(
            "positive_signals"
        ),
        F.when(by_text, keyword_signals(BLOCKED_WORDS[m], text)).otherwise(_top_signals(PENALTY_SIGNALS[m], columns)).alias(
            "penalty_signals"
        ),
    ]


def rule_mood_match(mood: Column) -> Column:
    """1 when a track fits the given mood by simple thresholds, else 0."""
    f = {c: try_double(F.col(c)) for c in ("energy", "danceability", "valence", "acousticness", "instrumentalness")}
    fits = (
        ((mood == "workout") & (f["energy"] >= 0.72) & (f["danceability"] >= 0.68))
        | ((mood == "happy") & (f["valence"] >= 0.68))
        | ((mood == "melancholic") & (f["valence"] <= 0.35) & (f["energy"] <= 0.45))
        | ((mood == "study") & (f["acousticness"] >= 0.55) & (f["instrumentalness"] >= 0.08))
        | ((mood == "calm") & (f["energy"] <= 0.45))
    )
    return fits.cast("double")


def preferred_mood(energy: Column, danceability: Column, valence: Column, acousticness: Column, instrumentalness: Column) -> Column:
    """Mood inferred from mean features."""
    return (
        F.when((energy >= 0.72) & (danceability >= 0.68), "workout")
        .when(valence >= 0.68, "happy")
        .when((valence <= 0.35) & (energy <= 0.45), "melancholic")
        .when((acousticness >= 0.55) & (instrumentalness >= 0.08), "study")
        .otherwise("calm")
    )


def mood_fit_label(score: Column) -> Column:
    return F.when(score >= 0.70, "High").when(score >= 0.40, "Medium").otherwise("Low")


def exploration_label(level: Column) -> Column:
    name = F.when(level <= 0.25, "Familiar").when(level >= 0.7, "Exploratory").otherwise("Balanced")
    return F.concat(name, F.lit(" "), F.bround(level * 100, 0).cast("int").cast("string"), F.lit("%"))
