"""nimbora: station climatology analytics declared as Spark DataFrame plans."""
