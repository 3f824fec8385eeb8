"""Column functions: text as it is compared, cleaned, decoded and shown."""
