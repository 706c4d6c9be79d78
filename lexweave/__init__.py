"""lexweave: citable search, verification and evaluation over structured documents, as Spark plans."""
