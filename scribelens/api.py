"""The engine's public names."""

from .plans.consensus import Settings, accept_ref_rate, accept_ref_rollup, corrected_transcripts, find_ref_edits, prominence, verdicts
from .plans.families import Family, families_for, family, make_family
from .plans.switch import pooled_switch_rate, switch_rate, switch_rates
from .functions.text import tokenize
from .sources.predictions import Predictions, available, load_dir, load_manifest, load_manifests, load_masks, load_predictions

__all__ = [
    "Family", "Predictions", "Settings", "accept_ref_rate", "accept_ref_rollup", "available", "corrected_transcripts", "families_for", "family", "find_ref_edits", "load_dir", "load_manifest",
    "load_manifests", "load_masks", "load_predictions", "make_family", "pooled_switch_rate", "prominence", "switch_rate", "switch_rates", "tokenize", "verdicts",
]
