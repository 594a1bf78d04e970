"""Customer-segmentation analytics on PySpark: datamart, features, personas and segment reports."""
