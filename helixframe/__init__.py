"""helixframe: k-mer analytics over collections of sequences, as Spark DataFrame operators."""
