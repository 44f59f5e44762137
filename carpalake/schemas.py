"""Fixed schemas of the engine's tables."""

from __future__ import annotations

COHORT = "id BIGINT, boneage DOUBLE, male INT, boneage_ic DOUBLE"
COHORT_CSV = "id BIGINT, boneage DOUBLE, male STRING"
STATS = "boneage_mean DOUBLE, boneage_std DOUBLE, idade_cron_mean DOUBLE, idade_cron_std DOUBLE"
ATLAS = "band INT, lo DOUBLE, hi DOUBLE, title STRING, carpus ARRAY<STRING>, epiphyses ARRAY<STRING>, ref STRING"
IMAGE = "id BIGINT, height INT, width INT, channels INT, data BINARY"
PREDICTION = "bone_age_meses DOUBLE, bone_age_anos INT, bone_age_meses_r INT, delta_meses DOUBLE, status STRING"
HISTORY = "session_id BIGINT, ts TIMESTAMP, years INT, months INT, male INT, months_total DOUBLE, is_clear BOOLEAN"
METRICS = "run_id BIGINT, epoch INT, train_loss DOUBLE, val_mae DOUBLE"

#: Ages are in months; sex is 0 for female and 1 for male.
MONTHS_MIN, MONTHS_MAX, WINDOW_MONTHS, AXIS_MONTHS = 0.0, 228.0, 12, 216
