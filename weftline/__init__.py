"""weftline: labelled tables and ordered price series as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame (or a ``Line``, which
is a DataFrame with a known order).  Nothing is collected except answers of a
fixed size: one row of statistics, or one row of group-size totals.
"""

from weftline.plans.ordered import Frame, Line

__all__ = ["Frame", "Line"]
__version__ = "0.1.0"
