"""gridloom: infrastructure-map data preparation as Spark DataFrame operators."""
