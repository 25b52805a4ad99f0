"""PySpark-native analytics for account-to-account transfer ledgers."""
