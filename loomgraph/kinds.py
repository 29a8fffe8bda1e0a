"""The closed domains of the graph: node kinds with their labels, edge kinds, providers, and the resource allow-list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kind and label prefix. Tags and configuration resources have two identity fields and labels of their own.
NODE_KINDS = """
GenericIpAddress Generic::IpAddress
GenericHostname Generic::Hostname
AwsRegion AWS::Region
AwsTag AWS::Tag
AwsEc2Instance AWS::Ec2Instance
AwsEc2Vpc AWS::EC2::VPC
AwsEc2Subnet AWS::EC2::Subnet
AwsEc2AvailabilityZone AWS::EC2::AvailabilityZone
AwsEc2SecurityGroup AWS::Ec2SecurityGroup
AwsEc2Eni AWS::Ec2Eni
AwsEc2RouteTable AWS::EC2::RouteTable
AwsEc2InternetGateway AWS::EC2::InternetGateway
AwsEc2NatGateway AWS::EC2::NatGateway
AwsEc2Eip AWS::EC2::Eip
AwsEcsCluster AWS::EcsCluster
AwsLambdaFunction AWS::Lambda::Function
AwsIamRole AWS::IAM::Role
AwsElbLoadBalancer AWS::ELB::LoadBalancer
AwsElbTargetGroup AWS::ELB::TargetGroup
AwsRoute53HostedZone AWS::Route53::HostedZone
AwsRoute53RecordSet AWS::Route53::RecordSet
AwsEksCluster AWS::EKS::Cluster
AwsApiGatewayRestApi AWS::ApiGateway::RestApi
AwsRdsDbInstance AWS::RDS::DbInstance
AwsDynamoDbTable AWS::DynamoDb::Table
AwsSqsQueue AWS::SQS::Queue
AwsSnsTopic AWS::SNS::Topic
AwsCloudFrontDistribution AWS::CloudFront::Distribution
AwsConfigResource
GcpProject GCP::Project
GcpComputeInstance GCP::Compute::Instance
GcpComputeNetwork GCP::Compute::Network
GcpComputeSubnetwork GCP::Compute::Subnetwork
GcpComputeFirewall GCP::Compute::Firewall
GcpComputeForwardingRule GCP::Compute::ForwardingRule
GcpComputeZone GCP::Compute::Zone
GcpSqlInstance GCP::SQL::Instance
GcpDnsManagedZone GCP::DNS::ManagedZone
GcpGkeCluster GCP::GKE::Cluster
GcpCloudFunction GCP::CloudFunctions::Function
GcpStorageBucket GCP::Storage::Bucket
GcpPubSubTopic GCP::PubSub::Topic
GcpPubSubSubscription GCP::PubSub::Subscription
GcpCloudRunService GCP::CloudRun::Service
AzureVirtualMachine Azure::Compute::VirtualMachine
AzureVirtualNetwork Azure::Network::VirtualNetwork
AzureSubnet Azure::Network::Subnet
AzureNetworkInterface Azure::Network::NetworkInterface
AzureNetworkSecurityGroup Azure::Network::NetworkSecurityGroup
AzurePublicIpAddress Azure::Network::PublicIpAddress
AzureStorageAccount Azure::Storage::StorageAccount
AzureManagedCluster Azure::Containers::ManagedCluster
AzureSqlServer Azure::Databases::SqlServer
AzureAppService Azure::Web::AppService
AzureFunctionApp Azure::Web::FunctionApp
AzureApiManagement Azure::Web::ApiManagement
AzureCosmosDb Azure::Databases::CosmosDb
AzureServiceBus Azure::Integration::ServiceBus
AzureEventGridTopic Azure::Integration::EventGridTopic
AzureDnsZone Azure::Network::DnsZone
AzureCdnProfile Azure::Network::CdnProfile
AzureServiceTag Azure::Network::ServiceTag
CloudflareZone Cloudflare::Zone
CloudflareDnsRecord Cloudflare::DnsRecord
CloudflareWorker Cloudflare::Worker
CloudflareDurableObject Cloudflare::DurableObject
CloudflareKvNamespace Cloudflare::KvNamespace
CloudflareR2Bucket Cloudflare::R2Bucket
CloudflareD1Database Cloudflare::D1Database
ExternalService External::Service
"""
# Edge kinds.
EDGE_KINDS = ["Contains", "ConnectsTo", "DependsOn", "AttachedTo", "HasIp", "RoutesTo", "ResolvesTo"]
# Configuration resource types that are kept or dropped whatever the default.
ALLOWED = """
AWS::RDS::DBClusterSnapshot no
AWS::StepFunctions::StateMachine no
AWS::ApiGateway::Stage no
AWS::ApiGatewayV2::Api no
AWS::EC2::NetworkAcl no
AWS::EC2::EIP no
AWS::EC2::NetworkInterface no
AWS::EC2::NatGateway no
AWS::SNS::Topic no
AWS::RDS::DBCluster yes
AWS::S3::Bucket yes
AWS::SQS::Queue yes
AWS::EC2::RouteTable no
AWS::EC2::VPC yes
AWS::EC2::Instance yes
AWS::ElasticLoadBalancing::LoadBalancer yes
AWS::ElasticLoadBalancingV2::LoadBalancer yes
AWS::Redshift::ClusterSubnetGroup yes
AWS::RDS::DBSubnetGroup yes
AWS::EC2::Subnet yes
AWS::EC2::InternetGateway no
AWS::ECS::Cluster yes
AWS::Lambda::Function yes
AWS::RDS::DBInstance yes
AWS::EKS::Cluster yes
AWS::ElasticLoadBalancingV2::Listener yes
AWS::Route53Resolver::ResolverRuleAssociation yes
AWS::EC2::VPCEndpoint yes
AWS::Route53Resolver::ResolverRule yes
AWS::DynamoDB::Table yes
"""
# Resource types that the graph query of the third provider asks for.
AZURE_TYPES = """
microsoft.compute/virtualmachines
microsoft.network/virtualnetworks
microsoft.network/networksecuritygroups
microsoft.network/publicipaddresses
microsoft.storage/storageaccounts
microsoft.containerservice/managedclusters
microsoft.sql/servers
microsoft.web/sites
microsoft.apimanagement/service
microsoft.documentdb/databaseaccounts
microsoft.servicebus/namespaces
microsoft.eventgrid/topics
microsoft.network/dnszones
microsoft.cdn/profiles
""".split()

#: kind -> label prefix ("" where the first identity field is the prefix)
PREFIXES = {line.split(" ")[0]: line.partition(" ")[2] for line in NODE_KINDS.strip().split("\n")}
#: resource type -> kept
ALLOW_LIST = {line.split()[0]: line.split()[1] == "yes" for line in ALLOWED.strip().split("\n")}


def node_kinds(spark: SparkSession) -> DataFrame:
    """kind, prefix: a dimension of 70 rows."""
    return spark.createDataFrame(list(PREFIXES.items()), "kind string, prefix string")


def edge_kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in EDGE_KINDS], "kind string")


def allow_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ALLOW_LIST.items()), "resource_type string, included boolean")
