"""Every threshold, weight and word list that decides a result, in one place."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Settings:
    # Scoring.
    min_peer_group_n: int = 30
    cost_z: float = 2.5
    stall_months: int = 6
    stall_spend_percent: float = 10.0
    ratio_z: float = 2.0
    concentration_z: float = 2.0
    concentration_min_span: int = 3
    concentration_min_works: int = 2
    flag_weights: dict = field(
        default_factory=lambda: {
            "cost_outlier": 30.0,
            "stalled_work": 25.0,
            "expenditure_mismatch": 25.0,
            "agency_concentration": 20.0,
        }
    )
    flags_cap: float = 80.0
    ensemble_weight: float = 20.0
    forest_trees: int = 200
    forest_sample: int = 256
    forest_seed: int = 42
    lof_neighbours: int = 20
    ratio_feature_cap: float = 5.0


SETTINGS = Settings()

FLAGS = tuple(SETTINGS.flag_weights)

# Statuses and policy.
UNDER_IMPLEMENTATION = ("Sanctioned", "In Progress")
COMPLETION_STATUSES = ("Recommended", "Sanctioned", "In Progress", "Completed")
WORK_CATEGORIES = (
    "Road",
    "Drinking Water",
    "School",
    "Health",
    "Community Infrastructure",
    "Electricity",
    "Sanitation",
)
QUOTA_PERCENT = 10
SANCTION_DAYS_LIMIT = 45
COMPLETION_DAYS_LIMIT = 365
NO_PAYMENT_DAYS = 90
PENDENCY_KINDS = ("late_sanction", "open_past_one_year", "no_payment_90_days")
THIRD_PARTY_FULL_INR = 2_500_000
THIRD_PARTY_HALF_INR = 1_500_000

# Duplicate finding.
FINDER_VERSION = "candidate_generation_v0"
CHARACTER_MIN = 0.80
DISTRICT_CHARACTER_MIN = 0.90
TOKEN_JACCARD_MIN = 0.75
TOKEN_SHARED_MIN = 3
SCORE_DECIMALS = 4
PER_WORK_LIMIT_INR = 1_500_000
GROUP_TOTAL_FLOOR_INR = 2_500_000
COMMON_TOKENS = tuple(
    "and at block construction from gram high house in installation ke light near no of "
    "panchayat road to village".split()
)

MAX_PAGE_SIZE = 10_000  # a page's ids are broadcast: no page is larger

# Judged pairs.
JUDGED_FINDER = "judged_same_asset_same_place"
JUDGED_VERSION = "work_candidate_derivation_v1"
PLACE_STOPLIST = tuple("village gram ward road school shamshan ghat community hall".split())
CONTINUATION_MARKERS = ("phase", "continuation", "continue", "remaining", "balance work")

# Inspection outcomes; None is inconclusive.
OUTCOME_IS_ISSUE = {
    "work_present_and_matches": False,
    "work_present_but_differs": True,
    "work_not_found_at_site": True,
    "documentation_incomplete": True,
    "duplicate_of_another_work": True,
    "agency_unresponsive": None,
}
MIN_REACHED_PER_GROUP = 30
WILSON_Z = 1.959963984540054

# Delay model.
PRIOR_SMOOTHING = 20
MIN_CATEGORY_ROWS = 30
WATCH_SHARE = 0.10
MIN_TEST_AUC = 0.65
MIN_TEST_LIFT = 1.8


def config_sha256(settings: Settings = SETTINGS) -> str:
    text = json.dumps(asdict(settings), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()
