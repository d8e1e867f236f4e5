"""Pipeline stages, each a function (DataFrame, specification, context) -> DataFrame.

``STAGES`` maps stage names to them; importing this package fills it.
"""

from docmill.operators import fill, group, join, shape, sinks, windows  # noqa: F401
from docmill.operators.base import STAGES, Context, run_pipeline  # noqa: F401
