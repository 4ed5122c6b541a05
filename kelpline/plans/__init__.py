"""Join strategies that depend on sizes and skew."""
