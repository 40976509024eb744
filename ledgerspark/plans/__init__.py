"""What source texts, plans and logs say about a workload."""
