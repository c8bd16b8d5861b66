"""Security analytics over event, flow and name tables as Spark DataFrame plans."""
