"""Analytics over text corpora that change in time, as Spark DataFrame plans."""
