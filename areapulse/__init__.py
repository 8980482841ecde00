"""Regional text indicators and nowcasting on Spark DataFrames."""
