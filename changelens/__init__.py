"""changelens: change-review analytics as Spark DataFrame operators."""

from changelens.options import DEFAULTS, Options

__all__ = ["DEFAULTS", "Options"]
