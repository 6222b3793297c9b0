"""Spark-native analytics for sequence cohorts: quality control, sequence algebra,
stratified cohorts, statistics, dating and detector consensus as DataFrame operators."""
