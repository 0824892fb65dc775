"""Training-data operators: each module holds one operator, ``queries`` and ``contracts`` register them."""
