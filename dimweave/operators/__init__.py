"""DataFrame operators of the demand dimension."""

from dimweave.operators.eav import eav_rows, pick_all, pick_latest, pick_max_date, spine
from dimweave.operators.fanout import fan_out, hot_cuts, product
from dimweave.operators.materialize import Stored, write_shared
from dimweave.operators.joins import gated, gated_left_chain, join_flag, with_null_rows
from dimweave.operators.pivot import latest_pick, latest_values, scalar_picks
from dimweave.operators.stages import current_stage, existence_flag, role_join, stage_log, stages_and_flag
from dimweave.operators.topk import desc_nulls_first, top1_per_key

__all__ = [
    "Stored",
    "current_stage",
    "desc_nulls_first",
    "eav_rows",
    "existence_flag",
    "fan_out",
    "gated",
    "gated_left_chain",
    "hot_cuts",
    "join_flag",
    "latest_pick",
    "latest_values",
    "pick_all",
    "pick_latest",
    "pick_max_date",
    "product",
    "role_join",
    "scalar_picks",
    "spine",
    "stage_log",
    "stages_and_flag",
    "top1_per_key",
    "with_null_rows",
    "write_shared",
]
