"""Write-side batch jobs: request table in, accepted rows, rejected rows with reasons and new table images out."""
