"""cloneloom: a PySpark-native engine for sequence repertoires and other weighted-abundance data."""
