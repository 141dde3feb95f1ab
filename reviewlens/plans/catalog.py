"""Imports every query module so that each registers its queries."""

from . import q_evaluate  # noqa: F401
from . import q_parse  # noqa: F401
from . import q_prepare  # noqa: F401
from . import q_profile  # noqa: F401
from . import q_vectors  # noqa: F401
from . import q_score  # noqa: F401
from . import q_sources  # noqa: F401
