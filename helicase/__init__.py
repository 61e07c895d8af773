"""helicase: DNA sequencing analytics as Spark DataFrames.

Reads, reference genomes and annotations are plain DataFrames; every operator
takes DataFrames and returns a DataFrame, so plans compose and stay lazy.
"""

__version__ = "0.1.0"
