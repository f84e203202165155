"""stagecraft: file-to-table pipelines and text analytics as Spark DataFrame plans.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except tiny bounded control values (loop counters).
"""

from stagecraft.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
