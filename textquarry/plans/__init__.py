"""From a schema to DataFrames: what each scorer is asked for, and how its rows are decoded."""
