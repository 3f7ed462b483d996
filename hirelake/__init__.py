"""hirelake: job-catalogue analytics and training-data operators as Spark plans."""
