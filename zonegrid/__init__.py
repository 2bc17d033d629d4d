"""zonegrid: zone x 15-minute demand/supply features, forecasting and scoring on Spark."""

__version__ = "0.1.2"
