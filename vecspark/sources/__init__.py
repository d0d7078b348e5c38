"""Vector file formats, generators and stored indexes."""
