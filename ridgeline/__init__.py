"""Terrain, network, climate and vector analytics expressed as Spark DataFrames."""
