"""All registered queries (imported for their registration side effect).

Entity = customer, period = order year; see ``sources/standin.py``.
"""

from panelcast.plans import q_eval, q_ingest, q_joins, q_long, q_models, q_outputs, q_panel, q_profile, q_project  # noqa: F401
