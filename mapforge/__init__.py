"""mapforge: time-ordered detector data, sky maps and linear operators on Spark DataFrames."""
