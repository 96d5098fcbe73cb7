"""tallyflow: Spark-native payment-pattern analytics."""
