"""dolomite: a PySpark-native engine for mining structured rules out of document collections."""
