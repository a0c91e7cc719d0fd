"""offerlake: a job-offer lakehouse and hybrid CV search, written as Spark DataFrame plans."""

__version__ = "0.1.0"
