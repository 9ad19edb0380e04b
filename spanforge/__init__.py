"""Timeline decisions on Spark: interval algebra over labelled time ranges, per media item."""
