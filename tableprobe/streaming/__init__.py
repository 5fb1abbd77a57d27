"""Results that follow arriving files."""

from .live import current_profile, keep_current, keep_profile, latest, live_profile, live_value_counts, read_arriving

__all__ = ["current_profile", "keep_current", "keep_profile", "latest", "live_profile", "live_value_counts", "read_arriving"]
