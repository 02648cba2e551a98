"""archspark: DataFrame operators for source-architecture analytics."""
