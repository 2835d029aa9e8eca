"""Imports every query module so that the registry is complete."""

from jobtide.plans import q_core  # noqa: F401
from jobtide.plans import q_text  # noqa: F401
from jobtide.plans import q_enrich  # noqa: F401
from jobtide.plans import q_flow  # noqa: F401
from jobtide.plans import q_payloads  # noqa: F401
from jobtide.plans import q_stream  # noqa: F401
from jobtide.plans import q_sinks  # noqa: F401
