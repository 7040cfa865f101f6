"""Where matrices come from: DataFrame layouts, arrays in memory, and chunk stores."""
