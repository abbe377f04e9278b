"""Discordant-pair analytics on Spark: DataFrame -> DataFrame operators, sources, sinks and plans."""
