"""From syntax trees to DataFrames: values, the expression compiler and the planner."""
