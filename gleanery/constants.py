"""Fixed values of the jobs, in one place."""

from __future__ import annotations

#: The clock of the queries; operators take theirs as a parameter.
NOW = "2024-01-31 00:00:00"

# Ranking and deck.
HALF_LIFE_HOURS = 24.0
DECK_SIZE, DECK_HOURS, DECK_CANDIDATES, DECK_PER_SOURCE, DECK_EXPLORE, NEUTRAL_BAND = 10, 72, 200, 3, 2, 0.5
FEEDBACK_WEIGHTS = {"open": 1.0, "useful": 0.65, "dismiss": -1.1}

# Near-duplicates.
DUPLICATE_COSINE = 0.86
WINDOW_DAYS, MIN_OWN, OWN_CAP = 30, 20, 100
RECIPE_SHARE, RECIPE_GRACE_DAYS = 0.8, 45

# Feed health.
DEAD_DAYS, STALL_FACTOR, CADENCE_SAMPLE, GRACE_DAYS = 14, 2.5, 15, 3
LOW_CREDIBILITY, LOW_PREFERENCE, HIGH_NEAR_DUP = -0.4, -2.0, 0.2
HEALTH_WEIGHTS = {"dead": 3.0, "low_credibility": 2.5, "low_pref": 2.0, "near_dup": 1.5}
RATE_FLOOR, STALE_HOURS = 12, 24

# Queues and ledgers.
MAX_ATTEMPTS, LEASE_HOURS, STALE_ROUND_HOURS, IN_FLIGHT = 3, 30, 36, 12
DAILY_BUDGET, BATCH_BUDGET, RUN_BATCH = 120, 120, 20
EMBED_GATE, EMBED_LEAD, RETENTION_DAYS, STALL_HOURS, THIN_BODY = 250, 250, 35, 26, 300

# Learning.
PRIOR_MASTERY = 0.3
#: Step of the mastery estimate by difficulty, for right and wrong answers.
ALPHAS = {"easy": (0.15, 0.35), "medium": (0.25, 0.25), "hard": (0.35, 0.15)}
RETRY_RIGHT_DAYS, RETRY_WRONG_DAYS, SESSION_POOL = 14, 4, 500
GROUND_CHARS, GROUND_OVERLAP = 24, 0.12
POOL_PER_CATEGORY, POOL_PER_RUN = 6, 24
SOURCE_CHARS, SOURCE_LINK_RATIO = 5000, 0.5

# Discovery.
DISCOVERY_SITES, CANDIDATE_CREDIBILITY = 40, -0.3
