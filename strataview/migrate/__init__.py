"""Schema migrations: plan against the live tables, apply, and roll back."""
from .plan import Change, Plan, desired, plan  # noqa: F401
from .history import History, apply, rollback  # noqa: F401
