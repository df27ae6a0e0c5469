"""Analytics over linked knowledge notes, written as Spark DataFrame transformations."""
