"""fathom: a Spark-native engine for modelling, profiling, generating and checking tables."""
