"""Social-network, spatial, career-sequence and record-cleaning operators on Spark."""

__version__ = "0.1.0"
