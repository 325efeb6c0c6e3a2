"""DataFrame to DataFrame operators over person records."""
