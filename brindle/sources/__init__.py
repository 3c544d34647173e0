"""Reading and writing of collections, requests and responses."""
