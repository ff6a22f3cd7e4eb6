"""Query-level objects: a crosstab over a cube, its spec, report batches and
presets."""

from statcube.plans.crosstab import Crosstab  # noqa: F401
from statcube.plans.presets import load_presets, preset_crosstab  # noqa: F401
from statcube.plans.report import ReportBatch  # noqa: F401
from statcube.plans.spec import CrosstabSpec  # noqa: F401
