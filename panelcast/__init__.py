"""panelcast: panel forecasting features, baselines and evaluation as Spark plans."""

__version__ = "0.1.0"
