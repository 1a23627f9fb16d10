"""tessella: analytics over content-addressed snapshot repositories, written as Spark DataFrame plans."""
